"""The final state of a review: findings, issues, annotations and repairs reconciled, and the facts
of a project as one document with a fingerprint that no order changes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.findings import CLASSES, is_priority, with_class
from quarryline.operators.replay import with_positions
from quarryline.sources.scratch import written

#: What a finding may be verified as, and what counts as a validated repair.
STATES = ("confirmed_error", "static_risk", "needs_review")
VALIDATED = ("Statically Validated", "Runtime Verified")
#: The category of findings that belong to the project, not to a file.
PROJECT_CATEGORY = "Multi-file Consistency"


def digest(prefix: str, *columns: str | Column) -> Column:
    """A short digest of the columns' values, nulls told apart from empty texts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 16))


def problem_of() -> Column:
    """The problem that a finding belongs to: the event that an analyzer names, or else the rule (the
    type where it has none), the place and the evidence, all of which have to be equal."""
    place = [F.coalesce("rule_id", "type").alias("rule"), "file", "cell", "line", "column", "evidence", "snippet"]
    return F.when(F.col("event").isNotNull(), digest("P-", F.col("event").alias("event"))).otherwise(digest("P-", *place))


def identity() -> Column:
    """What a finding and the issue it was made of have in common: code, the place and the rule; data,
    the file, the rule and the column."""
    code = F.struct("file", F.col("cell").cast("string").alias("cell"), F.col("line").cast("string").alias("line"), "rule_id")
    data = F.struct("file", F.col("column"), "rule_id")
    options = {"ignoreNullFields": "false"}
    return F.when(F.col("origin") == "code", F.to_json(code, options)).otherwise(F.to_json(data, options))


def display_numbers(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """(column, display_id) of different ids: F01, F02, … in their order."""
    number = F.col("_pos") + 1
    text = F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string"))
    return with_positions(ids.select(column).distinct(), column).select(column, F.concat(F.lit(prefix), text).alias("display_id"))


def finding_rows(findings: DataFrame, issues: DataFrame, repairs: DataFrame) -> DataFrame:
    """One row for each finding, with what belongs to it.

    ``findings`` (id, origin, rule_id, type, category, file, cell, line, column, severity, action,
    score_impact, evidence, snippet, event, verification_status); ``issues`` (position, origin, file,
    cell, line, column, rule_id) and ``repairs`` (position, id, validation_status).  Added are
    ``result_class``, ``problem``, ``priority``, ``part`` (code, data or project), ``issue``, the
    first issue of the same identity, ``repair``, the first repair of the finding, and whether that
    is ``validated``; null where there is none.
    """
    part = F.when(F.col("origin") == "code", "code").when(F.col("category") == PROJECT_CATEGORY, "project").otherwise("data")
    rows = with_class(findings).withColumns({"problem": problem_of(), "priority": F.coalesce(is_priority(), F.lit(False)), "part": part, "_identity": identity()})
    # aggregated before anything is joined, so that a common identity is one row
    first = issues.where("origin in ('code', 'data')").groupBy("origin", identity().alias("_identity")).agg(F.min("position").alias("issue"))
    mended = repairs.groupBy("id").agg(F.min("position").alias("repair"), F.bool_or(F.col("validation_status").isin(*VALIDATED)).alias("validated"))
    return rows.join(written(first, "first-issues"), ["origin", "_identity"], "left").join(written(mended, "repairs"), "id", "left").drop("_identity")


def problem_rows(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """(problem, n, result_class, verification_status, priority, explained): problems in their
    strongest class and their least certain state.  One is ``explained`` if an annotation (id, cause,
    potential_impact, recommendation) of one of its findings is complete."""
    full = annotations.where("cause <> '' and potential_impact <> '' and recommendation <> ''").select("id", F.lit(True).alias("_told")).distinct()
    order = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("result_class"))
    state = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.col("verification_status")), F.lit(0))
    # a state that isn't known needs review
    rank = F.when(state > 0, state).otherwise(len(STATES))
    grouped = rows.join(full, "id", "left").groupBy("problem").agg(
        F.count("*").alias("n"), F.min(order).alias("c"), F.max(rank).alias("s"), F.bool_or("priority").alias("priority"), F.coalesce(F.bool_or("_told"), F.lit(False)).alias("explained")
    )
    name = lambda of, k: F.element_at(F.array(*map(F.lit, of)), F.col(k).cast("int"))
    return grouped.select("problem", "n", name(CLASSES, "c").alias("result_class"), name(STATES, "s").alias("verification_status"), "priority", "explained")


def conclusions(rows: DataFrame, problems: DataFrame, repairs: DataFrame) -> DataFrame:
    """One row of counts: problems by state and class, those that ask for something, explained ones,
    findings of code that count or inform, repairs and validated ones."""
    count = lambda c: F.count(F.when(c, 1))
    state, kind = F.col("verification_status"), F.col("result_class")
    of_problems = problems.agg(
        F.count("*").alias("total"),
        *(count(state == s).alias(s) for s in STATES),
        *(count(kind == c).alias(c) for c in CLASSES if c != "static_risk"),
        count(F.col("explained")).alias("explained"),
        count(F.col("priority")).alias("priority"),
    )
    of_problems = of_problems.withColumn("actionable_total", F.col("confirmed_defect") + F.col("static_risk") + F.col("needs_verification"))
    quiet = (F.coalesce(F.col("score_impact"), F.lit(1.0)) == 0) | (F.coalesce(F.col("action"), F.lit("")) == "Informational")
    of_code = rows.where("part = 'code'").agg(count(~quiet).alias("code_issues"), count(quiet).alias("code_notes"))
    of_repairs = repairs.agg(F.count("*").alias("repairs"), count(F.col("validation_status").isin(*VALIDATED)).alias("validated_repairs"))
    return of_problems.crossJoin(of_code).crossJoin(of_repairs)  # one row each


def facts(parts: Mapping[str, DataFrame], project: str) -> DataFrame:
    """(project, document, n, fingerprint): what is known of each project as one JSON document.

    Each part is a table with a column ``project``; its other columns are the fields of an entry, and
    its entries an array of the document under the part's name, sorted by their texts, so neither
    order nor partitions change it.  A part without entries of a project is an empty array.  ``n`` is
    the number of entries; the fingerprint is made of sums over entries, which are merged on the way,
    so it can be had of projects of any size; a document has to fit into a row.
    """
    bodies = None
    for name, df in parts.items():
        fields = [c for c in df.columns if c != project]
        body = df.select(F.col(project).alias("project"), F.lit(name).alias("part"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))
        bodies = body if bodies is None else bodies.unionByName(body)
    mark = F.conv(F.substring(F.sha2(F.concat_ws(":", "part", "body").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    per = bodies.groupBy("project").agg(
        F.count("*").alias("n"),
        F.sha2(F.concat_ws(":", F.sum(mark).cast("string"), F.count("*").cast("string")).cast("binary"), 256).alias("fingerprint"),
        *(F.sort_array(F.collect_list(F.when(F.col("part") == name, F.col("body")))).alias(f"p{k}") for k, name in enumerate(parts)),
    )
    arrays = [F.concat(F.lit(f'"{name}":['), F.array_join(f"p{k}", ","), F.lit("]")) for k, name in enumerate(parts)]
    return per.select("project", F.concat(F.lit("{"), F.concat_ws(",", *arrays), F.lit("}")).alias("document"), "n", "fingerprint")
