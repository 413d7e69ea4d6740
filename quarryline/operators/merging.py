"""Findings of copied artifacts as one, by similarity, never two of one file.

The findings of a group of artifacts are taken file by file, and in a file by position.  Each joins
the first earlier representative that means the same and has no finding of its file yet, or becomes
a representative itself.  Meaning the same isn't transitive, so the order decides, and a group's
findings of one rule have to be walked through one after another.

What is walked is kept small: files in which a rule found the same things in the same order join the
same representatives, as each of them meets what the first one met.  So only the first file of each
such profile takes part, and the others take over its answers by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.sources.scratch import written

#: Similarity of the snippets of findings that mean the same.
SAME_SNIPPET = 0.85
_SPACE = re.compile(r"\s+")


def plain_snippet(text: str | None) -> str:
    """A snippet as it is compared: without white space, case folded."""
    return _SPACE.sub("", text or "").casefold()


def same_finding(left: dict, right: dict, exact: bool, threshold: float = SAME_SNIPPET) -> bool:
    """Do two findings (root, text, type, cell) of one rule mean the same?  ``left`` is the earlier.

    Equal roots always do.  In exact copies the texts have to be equal; in near ones they have to be
    similar, or both findings of one type and cell, or of one type where a text is empty.
    """
    if left["root"] and left["root"] == right["root"]:
        return True
    if exact or left["text"] == right["text"]:
        return left["text"] == right["text"] and (exact or bool(left["text"]) or left["type"] == right["type"])
    if left["type"] == right["type"] and (not left["text"] or not right["text"] or left["cell"] == right["cell"]):
        return True
    if not left["text"] or not right["text"]:
        return False
    m = SequenceMatcher(None, left["text"], right["text"], autojunk=False)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


class Representatives:
    """The representatives of one rule in one group, in the order in which they came up."""

    def __init__(self, exact: bool, threshold: float) -> None:
        self.exact, self.threshold, self.held = exact, threshold, []
        self.known: dict[tuple, bool] = {}

    def same(self, k: int, item: dict) -> bool:
        """Whether the item means what the representative means, remembered for equal items."""
        key = (k, item["root"], item["text"], item["type"], item["cell"])
        if key not in self.known:
            self.known[key] = same_finding(self.held[k], item, self.exact, self.threshold)
        return self.known[key]

    def take(self, items: list[dict]) -> list[int]:
        """The representative's id for each finding of the next file."""
        out: list[int] = []
        taken: set[int] = set()
        for item in items:
            k = next((k for k in range(len(self.held)) if k not in taken and self.same(k, item)), len(self.held))
            if k == len(self.held):
                self.held.append(item)
            taken.add(k)
            out.append(self.held[k]["id"])
        return out


def representatives(findings: DataFrame, groups: DataFrame, threshold: float = SAME_SNIPPET) -> DataFrame:
    """(id, representative): for every finding the one that it is shown with, itself where alone.

    ``findings`` (id, file, position, rule_id, type, root, snippet, cell), with different ids and
    positions in a file; ``groups`` (name, primary, exact) says which files are copies of one
    another.  The number behind the last colon of a root, a line, is left out of it.  Null texts
    count as empty, and findings of files without a group, or without a file, stay alone.
    """
    root = F.regexp_replace(F.coalesce("root", F.lit("")), r":\d+$", "")
    item = F.struct("position", "id", root.alias("root"), "snippet", "type", "cell")
    joined = findings.join(groups, F.col("file") == F.col("name"), "left")
    alone = joined.where("primary is null").select("id", F.col("id").alias("representative"))
    shape = F.sha2(F.to_json(F.transform("items", lambda i: F.struct(i["root"], i["snippet"], i["type"], i["cell"]))).cast("binary"), 256)
    files = joined.where("primary is not null").groupBy("primary", "exact", "rule_id", "file").agg(F.array_sort(F.collect_list(item)).alias("items"))
    files = written(files.withColumn("profile", shape), "profiles")
    key = ["primary", "rule_id", "profile"]
    first = files.groupBy("exact", *key).agg(F.min_by("items", "file").alias("items"), F.min("file").alias("file"))
    walked = first.repartition("primary", "rule_id").sortWithinPartitions("primary", "rule_id", "file")
    types = dict(files.dtypes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if (row["primary"], row["rule_id"]) != current:
                    current, held = (row["primary"], row["rule_id"]), Representatives(row["exact"], threshold)
                found.append(held.take([i | {"text": plain_snippet(i["snippet"])} for i in row["items"]]))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], [*key, "found"])

    answers = walked.mapInArrow(walk, ", ".join(f"{c} {types[c]}" for c in key) + ", found array<long>")
    # written, so that a profile that very many files have can be split in the join
    told = files.select(*key, "items.id").join(written(answers, "answers"), key)
    pairs = told.select(F.explode(F.arrays_zip("id", "found")).alias("p")).select("p.id", F.col("p.found").alias("representative"))
    return alone.unionByName(pairs)


def merged_by_similarity(findings: DataFrame, groups: DataFrame, threshold: float = SAME_SNIPPET) -> DataFrame:
    """(id, file, rule_id, snippet, n, files): one row for each representative of ``findings``, as
    for :func:`representatives`.  ``file`` is the primary one of exact copies, else the finding's own;
    ``files`` are all that have the finding, ``n`` how many findings it stands for."""
    assigned = written(representatives(findings, groups, threshold), "representatives")
    members = assigned.join(findings.select("id", "file"), "id").groupBy("representative").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("file")).alias("files"))
    shown = members.join(findings, F.col("representative") == F.col("id")).join(groups, F.col("file") == F.col("name"), "left")
    file = F.when(F.coalesce("exact", F.lit(False)), F.col("primary")).otherwise(F.col("file"))
    return shown.select("id", file.alias("file"), "rule_id", "snippet", "n", "files")
