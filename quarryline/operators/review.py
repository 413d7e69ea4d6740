"""What is shown and passed on of an audit: samples, rankings, matches, roll-ups, redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.operators.findings import actionable
from quarryline.operators.profile import numeric_columns
from quarryline.operators.replay import with_positions

#: Names of secrets in assignments.
SECRET_NAME = r"(?i)(?:password|passwd|secret|token|api_?key|access_?key)"
#: Metric functions and what they measure.
CLASSIFICATION_METRICS = {
    "accuracy_score": "accuracy", "precision_score": "precision", "recall_score": "recall", "f1_score": "f1", "roc_auc_score": "roc_auc",
    "average_precision_score": "pr_auc", "log_loss": "log_loss", "confusion_matrix": "confusion_matrix", "classification_report": "classification_report",
}
REGRESSION_METRICS = {
    "mean_absolute_error": "mae", "mean_squared_error": "mse", "root_mean_squared_error": "rmse", "r2_score": "r2", "mean_absolute_percentage_error": "mape",
}


def first_values(df: DataFrame, column: str, row_id: str, n: int = 5) -> DataFrame:
    """(value, first_row): the first ``n`` different values in row order."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(row_id).alias("first_row")).orderBy("first_row").limit(n)


def affected_rows(rows: DataFrame, row_id: str, n: int = 20) -> DataFrame:
    """The smallest row ids of the rows that a rule found."""
    return rows.select(row_id).orderBy(row_id).limit(n)


def glob_match(value: Column, pattern: str) -> Column:
    """Does the value match a case-sensitive glob of ``*``, ``?`` and ``[...]``?"""
    import fnmatch

    return F.coalesce(value, F.lit("")).rlike("^(?s:" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + ")$")


def selected(findings: DataFrame, selector: Mapping[str, str]) -> DataFrame:
    """The findings whose fields all match the selector's globs."""
    out = findings
    for field, pattern in selector.items():
        out = out.where(glob_match(F.col(field).cast("string"), pattern))
    return out


def display_ids(df: DataFrame, order: str, prefix: str = "P") -> DataFrame:
    """``df`` with ``display_id``: P01, P02, … in the order of a column."""
    number = (F.col("_pos") + 1).cast("string")
    return with_positions(df, order).withColumn("display_id", F.concat(F.lit(prefix), F.when(F.col("_pos") < 9, F.concat(F.lit("0"), number)).otherwise(number))).drop("_pos")


def low_roll_up(findings: DataFrame) -> DataFrame:
    """(category, type, n) of the findings of low severity that count."""
    return findings.where(actionable() & (F.col("severity") == "Low")).groupBy("category", "type").agg(F.count("*").alias("n"))


def ranked_fragments(fragments: DataFrame, evidence: Sequence[str], n: int = 10) -> DataFrame:
    """(score, title, fragment): fragments of knowledge by twice the evidence words among their
    topic's keywords, and once those in the fragment itself; ties by title and text.

    ``fragments`` has (title, fragment, keywords array<string>); equal fragments are shown once.
    """
    words = F.array(*map(F.lit, evidence))
    topic = F.array_intersect("keywords", words)
    score = 2 * F.size(topic) + F.size(F.filter(topic, lambda k: F.contains(F.lower("fragment"), k)))
    scored = fragments.select(score.alias("score"), "title", "fragment").where("score > 0")
    best = scored.groupBy("fragment").agg(F.min(F.struct((-F.col("score")).alias("s"), "title")).alias("b"))
    return best.select((-F.col("b.s")).alias("score"), F.col("b.title").alias("title"), "fragment").orderBy(F.desc("score"), "title", "fragment").limit(n)


def repairs_of(findings: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each finding (id, type, file) with the first repair (position, problem, location) of its
    type whose location is in its file: the part before the place, which follows the last colon.
    ``repair`` is null where there is none.  The first repair of each type and file is found
    before anything is joined."""
    first = repairs.groupBy(F.col("problem").alias("type"), F.regexp_extract("location", "^(.*?)(?::[^:]*)?$", 1).alias("file")).agg(F.min("position").alias("repair"))
    return findings.join(first, ["type", "file"], "left").select("id", "repair")


def coverage(problems: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row (total, explained, filled, priority_total, priority_filled): how many problems
    (problem, priority) have a complete annotation (problem, cause, potential_impact,
    recommendation)."""
    full = annotations.where("cause <> '' and potential_impact <> '' and recommendation <> ''").select("problem", F.lit(True).alias("done")).distinct()
    joined = problems.join(full, "problem", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    count = lambda c: F.count(F.when(c, 1))
    return joined.agg(F.count("*").alias("total"), count(F.col("done")).alias("explained"), count(~F.col("done")).alias("filled"), count(F.col("priority")).alias("priority_total"), count(F.col("priority") & ~F.col("done")).alias("priority_filled"))


def unused_columns(columns: DataFrame, used: DataFrame) -> DataFrame:
    """The columns (column) that are neither features nor target (column)."""
    return columns.join(used, "column", "left_anti")


def overall_missing(null_profile: DataFrame) -> DataFrame:
    """One row (missing_rate): the mean of the columns' rates."""
    return null_profile.agg(F.coalesce(F.avg("null_rate"), F.lit(0.0)).alias("missing_rate"))


def overview(null_profile: DataFrame, findings: DataFrame) -> DataFrame:
    """One row (rows, columns, missing_rate, outliers) of a table's null profile and findings: the
    figures above its tables.  ``outliers`` are the values that any finding of outliers counts."""
    table = null_profile.agg(F.max("rows").alias("rows"), F.count("*").alias("columns"), F.coalesce(F.avg("null_rate"), F.lit(0.0)).alias("missing_rate"))
    far = findings.agg(F.coalesce(F.sum(F.when(F.col("category") == "Outliers", F.col("detected_count"))), F.lit(0)).alias("outliers"))
    return table.crossJoin(far)  # one row each


def missing_table(null_profile: DataFrame) -> DataFrame:
    """(Column, Missing): all columns as shown, the highest share first, in percent with two digits."""
    shown = null_profile.select(F.col("column").alias("Column"), F.format_string("%.2f%%", F.col("null_rate") * 100).alias("Missing"), "null_rate")
    return shown.orderBy(F.desc("null_rate"), "Column").drop("null_rate")


def type_table(df: DataFrame) -> DataFrame:
    """(Column, Type, Kind): the columns in order with their type, numeric or categorical."""
    numeric = set(numeric_columns(df))
    return df.sparkSession.createDataFrame([(c, t, "numeric" if c in numeric else "categorical") for c, t in df.dtypes], "Column string, Type string, Kind string")


def statistics_table(profile: DataFrame, digits: int = 4) -> DataFrame:
    """A numeric profile as shown: numbers rounded, columns by name."""
    rounded = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in profile.dtypes]
    return profile.select(*rounded).orderBy("column")


def merged_flows(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """(project, kind, place, file, label): the recorded events of all files of a project as one
    flow.  ``events`` (project, file, kind, label, and the columns of ``order``, which are a file's
    place in the project and an event's place in the file); ``place`` counts the events of a kind
    from 1, file by file."""
    w = Window.partitionBy("project", "kind").orderBy(*order)
    return events.select("project", "kind", F.row_number().over(w).alias("place"), "file", "label")


def flow_summary(events: DataFrame, order: Sequence[str], roles: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """(project, files, primary, <role> arrays, evaluation_detected) of the merged flow: the file with the most
    different kinds of events, of equal ones the first; the different labels of each role's events
    in the order in which they first come; and whether anything is evaluated."""
    place = F.struct(*order)
    files = events.groupBy("project", "file").agg(F.count_distinct("kind").alias("kinds"), F.min(place).alias("at"))
    best = files.groupBy("project").agg(F.count("*").alias("files"), F.min_by("file", F.struct((-F.col("kinds")).alias("k"), "at")).alias("primary"))
    firsts = events.where(F.col("kind").isin(*roles)).groupBy("project", "kind", "label").agg(F.min(place).alias("at"))
    named = firsts.groupBy("project").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == r, F.struct("at", "label")))), lambda x: x["label"]).alias(r) for r in roles))
    metrics = events.groupBy("project").agg(F.bool_or(F.col("kind") == "metric").alias("evaluation_detected"))
    out = best.join(metrics, "project").join(named, "project", "left")
    return out.select("project", "files", "primary", *(F.coalesce(r, F.array().cast("array<string>")).alias(r) for r in roles), "evaluation_detected")


def test_sample(rows: Column, test_size: Column) -> Column:
    """struct(test_rows, test_ratio, insufficient): the test part that a split size means; fewer
    than 20 rows or 5 % are insufficient."""
    share = (test_size > 0) & (test_size < 1)
    n = F.when(share, F.ceil(rows * test_size)).otherwise(test_size).cast("long")
    ratio = F.when(share, test_size).otherwise(n / rows)
    return F.struct(n.alias("test_rows"), ratio.alias("test_ratio"), ((n < 20) | (ratio < 0.05)).alias("insufficient"))


def split_role(name: Column) -> Column:
    """validation, test or train, by the first that the name speaks of in this order."""
    n = F.lower(name)
    return F.when(n.rlike("validation|valid|_val|val_"), "validation").when(F.contains(n, F.lit("test")), "test").when(F.contains(n, F.lit("train")), "train")


def metric_of(function: Column) -> Column:
    """struct(task, metric) of a metric function's name."""
    tasks = (("classification", CLASSIFICATION_METRICS), ("regression", REGRESSION_METRICS))
    return F.coalesce(*(F.when(function == f, F.struct(F.lit(task).alias("task"), F.lit(m).alias("metric"))) for task, known in tasks for f, m in known.items()))


def redacted(code: Column) -> Column:
    """Code in which quoted values assigned to secret-sounding names keep their first and last
    three characters at most; values of six or fewer keep none."""
    name = rf"""([A-Za-z_]*{SECRET_NAME}[A-Za-z_]*["']?\s*[:=]\s*["'])"""
    short = F.regexp_replace(code, name + r"""([^"']{1,6})(["'])""", "$1***$3")
    return F.regexp_replace(short, name + r"""([^"']{3})[^"']+([^"']{3})(["'])""", "$1$2...$3$4")


def parsed_payloads(texts: DataFrame, column: str, schema: str, required: Sequence[str]) -> DataFrame:
    """``texts`` with ``payload`` (null where the JSON doesn't parse into the schema) and ``fault``:
    malformed, or the first required field that is missing."""
    parsed = texts.withColumn("payload", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    fault = F.when(F.try_parse_json(F.col(column)).isNull(), "malformed")
    for field in required:
        fault = fault.when(F.col(f"payload.{field}").isNull(), f"missing {field}")
    return parsed.withColumn("fault", fault)


def last_of_each(records: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Records that are equal in ``key`` once, with the values of the last one, at the place of
    the first (``place``)."""
    rest = [c for c in records.columns if c not in key and c != order]
    grouped = records.groupBy(*key).agg(F.min(order).alias("place"), F.max_by(F.struct(*rest), order).alias("r"))
    return grouped.select(*key, "place", *(F.col(f"r.{c}").alias(c) for c in rest))


def consecutive_repeats(calls: DataFrame, group: str, order: str, call: str) -> DataFrame:
    """The rows whose call equals the one just before it in the same group."""
    return calls.withColumn("_before", F.lag(call).over(Window.partitionBy(group).orderBy(order))).where(F.col("_before") == F.col(call)).drop("_before")


def comparable_pairs(datasets: DataFrame) -> DataFrame:
    """(a, b) of files whose schemas are worth comparing: they share a parent or a consumer, and
    neither is the other's parent.  ``datasets`` has (file, parents, consumers) arrays."""
    ties = datasets.select("file", F.explode(F.array_union(F.transform("parents", lambda p: F.concat(F.lit("p:"), p)), F.transform("consumers", lambda c: F.concat(F.lit("c:"), c)))).alias("tie"))
    pairs = ties.select(F.col("file").alias("a"), "tie").join(ties.select(F.col("file").alias("b"), "tie"), "tie").where("a < b").select("a", "b").distinct()
    direct = datasets.select(F.col("file"), F.explode("parents").alias("parent"))
    direct = direct.select(F.least("file", "parent").alias("a"), F.greatest("file", "parent").alias("b")).distinct()
    return pairs.join(direct, ["a", "b"], "left_anti")


def judged_annotations(findings: DataFrame, annotations: DataFrame) -> DataFrame:
    """``annotations`` (id, …) with ``verdict``: accepted, unknown where no finding has the id, or
    repeated where several annotations claim one id (none of them is taken)."""
    claims = annotations.groupBy("id").agg(F.count("*").alias("_claims"))
    known = findings.select("id", F.lit(True).alias("_known")).distinct()
    joined = annotations.join(claims, "id").join(known, "id", "left")
    verdict = F.when(F.col("_known").isNull(), "unknown").when(F.col("_claims") > 1, "repeated").otherwise("accepted")
    return joined.withColumn("verdict", verdict).drop("_claims", "_known")


def merged_findings(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """(artifact, rule_id, snippet, file, n): findings of duplicate artifacts as one, by the rule
    and the snippet without white space; ``file`` is the first that has it.  ``findings`` (file,
    rule_id, snippet), ``groups`` (name, primary)."""
    plain = F.regexp_replace("snippet", r"(?U)\s+", "")
    joined = findings.join(groups, F.col("file") == F.col("name"), "left")
    grouped = joined.groupBy(F.coalesce("primary", "file").alias("artifact"), "rule_id", plain.alias("snippet"))
    return grouped.agg(F.min("file").alias("file"), F.count("*").alias("n"))


def missing_ranking(null_profile: DataFrame) -> DataFrame:
    """The columns with missing values, the highest rate first, then by name."""
    return null_profile.where("nulls > 0").orderBy(F.desc("null_rate"), "column")


def union_in_order(parts: Sequence[DataFrame], key: Sequence[str], order: str) -> DataFrame:
    """The rows of all parts, equal keys once, at the first place they have; places of a later part
    have to be behind those of the parts before it."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*key).agg(F.min(order).alias(order))


def best_flow(flows: DataFrame) -> DataFrame:
    """(view, flow, score): the flow with the highest score for each view, the first of equal ones."""
    best = flows.groupBy("view").agg(F.min(F.struct((-F.col("score")).alias("s"), "flow")).alias("b"))
    return best.select("view", F.col("b.flow").alias("flow"), (-F.col("b.s")).alias("score"))


def execution_gaps(cells: DataFrame, group: str, order: Sequence[str | Column], count: str) -> DataFrame:
    """(group, non_increasing, first_offender, unexecuted_after_executed) of notebook cells: cells whose
    execution count doesn't rise over that of the cell before, the place of the first of them, and
    cells that were never executed behind executed ones."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = cells.select(group, F.col(count).alias("_n"), F.row_number().over(w).alias("_at"), F.lag(count).over(w).alias("_prev"), F.max(count).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_top"))
    falls, skipped = F.col("_n") <= F.col("_prev"), F.col("_n").isNull() & F.col("_top").isNotNull()
    return marked.groupBy(group).agg(
        F.count(F.when(falls, 1)).alias("non_increasing"), F.min(F.when(falls, F.col("_at"))).cast("long").alias("first_offender"), F.count(F.when(skipped, 1)).alias("unexecuted_after_executed")
    )
