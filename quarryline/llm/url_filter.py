"""URL filters: fixed rules by host and path, and association rules mined by FP-growth.

A URL is a set of tokens: the labels of its host, the words of its path, a file ending, the names
of its parameters.  FP-growth mines token sets that go with a label; rules are pruned by support
and confidence, and a rule that a shorter one with the same label and no less confidence covers is
dropped.  A long URL that is repeated has as many frequent sets as its tokens have subsets, so two
kinds of tokens are told apart first, which loses no rule: a token that only one label goes with is
a rule by itself, which covers all longer ones, and isn't mined; tokens that occur in exactly the
same labelled URLs are mined as one, any of which meets a rule.  A rule is indexed by its rarest token, so a URL meets only rules that hold one of its
tokens, and the best rule whose tokens it all has decides.  Everything is DataFrame and ML
pipeline work inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host and path of the rules that judge before any mined one.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Least share of labelled URLs that hold a mined rule's tokens and its label.
MIN_SUPPORT = 0.002
#: Labelled URLs that have to hold a mined rule's tokens and its label whatever the share.
MIN_COUNT = 10
#: Least share of the label among labelled URLs with a mined rule's tokens.
MIN_CONFIDENCE = 0.8
_LABEL = "label="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    known = F.coalesce(at > 0, F.lit(False))
    return F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(known, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return F.coalesce(*fits)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The URL's distinct tokens, sorted: h: host words, p: path words (numbers left out),
    x: file ending, q: parameter names."""
    def tagged(tag: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")), lambda w: F.concat(F.lit(tag), w))

    name = F.translate(path, UPPER, LOWER)
    ending = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    return F.array_sort(
        F.array_distinct(
            F.concat(
                tagged("h:", F.split(host, "[.-]")),
                tagged("p:", F.split(F.regexp_replace(name, r"\.[a-z0-9]+$", ""), "[/._-]+")),
                tagged("x:", F.array(ending)),
                tagged("q:", F.transform(F.split(query, "&"), lambda kv: F.substring_index(kv, "=", 1))),
            )
        )
    )


def token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """(token, item, pure, label, n) of the tokens in at least ``least`` of the URLs that ``baskets``
    (tokens, label, n) count: ``item`` is what the token is mined as, the first of the tokens in
    just the same URLs, and itself for a ``pure`` one, in URLs of one label only."""
    each = baskets.select("label", "n", F.explode("tokens").alias("token"), *(F.xxhash64(F.lit(k), "tokens", "label").alias(f"h{k}") for k in (0, 1)))
    where = [F.bit_xor(f"h{k}").alias(f"h{k}") for k in (0, 1)]
    facts = each.groupBy("token").agg(F.sum("n").alias("n"), F.min("label").alias("label"), (F.min("label") == F.max("label")).alias("pure"), *where).where(F.col("n") >= least)
    facts = materialise(facts, "tokens")
    same = ["n", "h0", "h1"]
    first = facts.where("not pure").groupBy(*same).agg(F.min("token").alias("first"))
    return materialise(facts.join(first, same, "left").select("token", F.when(F.col("pure"), F.col("token")).otherwise(F.col("first")).alias("item"), "pure", "label", "n"), "token-classes")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """The rules (antecedent, label, confidence, support) of ``labelled`` (tokens array<string>,
    label), with items in place of tokens, and the tokens' :func:`token_classes`.

    Rows without tokens or label teach nothing; fewer than ``min_count`` labelled rows give no
    rules.
    """
    baskets = materialise(labelled.where("label is not null and size(tokens) > 0").groupBy("tokens", "label").agg(F.count("*").alias("n")), "baskets")
    total = baskets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # just under a whole count, so that rounding doesn't ask for one more
    least = math.ceil(max(min_support * total, min_count) - 1e-9)
    classes = token_classes(baskets, least)
    rules = classes.where("pure").select(F.array("token").alias("antecedent"), "label", F.lit(1.0).alias("confidence"), (F.col("n") / max(1, total)).alias("support"))
    mixed = classes.where("not pure").select("token", "item")
    items = baskets.select("tokens", "label", "n", F.explode("tokens").alias("token")).join(mixed, "token").groupBy("tokens", "label", "n").agg(F.collect_set("item").alias("items"))
    rows = items.select(F.array_append("items", F.concat(F.lit(_LABEL), "label")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    rows = materialise(rows.select("items"), "mined-baskets")
    n = rows.count()
    if n < least:
        return materialise(rules, "rules"), classes
    model = FPGrowth(itemsCol="items", minSupport=(least - 1e-6) / n, minConfidence=min_confidence).fit(rows)
    found = (
        model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].startswith(_LABEL))
        .where(~F.exists("antecedent", lambda t: t.startswith(_LABEL)))
        .select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 1000).alias("label"), "confidence", (F.col("support") * n / total).alias("support"))
    )
    found = materialise(found, "mined")
    # what a rule with one token less already says isn't said again
    shorter = found.select(F.col("antecedent").alias("part"), F.col("label").alias("same"), F.col("confidence").alias("had"))
    parts = found.where(F.size("antecedent") > 1).select("*", F.explode("antecedent").alias("less"))
    parts = parts.withColumn("part", F.array_remove("antecedent", F.col("less")))
    covered = parts.join(shorter, (parts["part"] == shorter["part"]) & (parts["label"] == shorter["same"]) & (shorter["had"] >= parts["confidence"]), "left_semi")
    kept = found.join(covered.select("antecedent", "label").distinct(), ["antecedent", "label"], "left_anti")
    return materialise(rules.unionByName(kept), "rules"), classes


def match_rules(token_sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, label): the label of each set's best rule, for the sets that have one.  Best is
    the highest confidence, then the longest rule, then the first in the order of its tokens."""
    n = rules.select(F.explode("antecedent").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    spread = rules.select("*", F.explode("antecedent").alias("item")).join(n, "item")
    index = spread.groupBy("antecedent", "label", "confidence").agg(F.min_by("item", F.struct("n", "item")).alias("anchor"))
    # of several tokens of one item, the first is the one that meets a rule
    items = token_sets.select("tokens", F.explode("tokens").alias("token")).join(classes.select("token", "item"), "token").groupBy("tokens", "item").agg(F.min("token").alias("token"))
    sets = items.groupBy("tokens").agg(F.collect_list(F.struct("item", "token")).alias("held"))
    met = sets.select("tokens", "held", F.explode("held.item").alias("anchor")).join(index, "anchor")
    met = met.where(F.size(F.array_except("antecedent", F.col("held.item"))) == 0)
    spelled = F.array_sort(F.transform(F.filter("held", lambda h: F.array_contains("antecedent", h["item"])), lambda h: h["token"]))
    rank = F.struct(-F.col("confidence"), -F.size("antecedent"), spelled, "label")
    return met.groupBy("tokens").agg(F.min_by("label", rank).alias("label"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    default: str = "allow",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_count: int = MIN_COUNT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rule`` is the longest fixed rule that fits, null where none does.  The URLs that a fixed
    rule judges are the labelled ones that association rules are mined from; these judge the
    others, and ``default`` where no mined rule applies.  A null URL, or one without ``://``, has
    an empty host and path and no tokens.  A long URL may be repeated any number of times.  A null id stays null, repeated rows are judged one by
    one, further columns are ignored, an empty table gives none.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumns({"fit": fitting_rule(F.col("host"), F.col("path"), rules), "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))})
    rows = materialise(rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("fixed"), "tokens"), "urls")
    mined, classes = mine_rules(rows.where("rule is not null").select("tokens", F.col("fixed").alias("label")), min_support, min_confidence, min_count)
    # each set of tokens is judged once, however many pages a host has
    labels = match_rules(rows.where("rule is null").select("tokens").distinct(), mined, classes).withColumnRenamed("tokens", "set")
    # written, so that the join below has a shuffle of its own, in which a hot set can be split
    labels = materialise(labels, "labels")
    open_, done = rows.where("rule is null"), rows.where("rule is not null")
    judged = open_.join(labels, F.col("tokens") == F.col("set"), "left").select("page_id", "host", "path", "rule", F.coalesce("label", F.lit(default)).alias("verdict"))
    return done.select("page_id", "host", "path", "rule", F.col("fixed").alias("verdict")).unionByName(judged)
