"""The findings relation: status, class, grouping, penalties, scores, evaluation against truth."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weight of a severity in the data score, the code score, the report score and the display score.
DATA_WEIGHTS = {"High": 8.0, "Medium": 3.5, "Low": 0.75}
CODE_WEIGHTS = {"High": 10.0, "Medium": 4.0, "Low": 1.25}
REPORT_WEIGHTS = {"High": 18.0, "Medium": 7.0, "Low": 2.0}
DISPLAY_WEIGHTS = {"High": 14.0, "Medium": 6.0, "Low": 1.5}
#: The classes of a problem, strongest first.
CLASSES = ("confirmed_defect", "static_risk", "needs_verification", "informational_observation")


def actionable() -> Column:
    """Findings that count: not informational, and not without impact."""
    return (F.coalesce(F.col("score_impact"), F.lit(1.0)) != 0) & (F.coalesce(F.col("action"), F.lit("")) != "Informational")


def with_status(findings: DataFrame) -> DataFrame:
    """``verification_status`` of data findings: confirmed only for invalid values or broken rules
    at high confidence."""
    confirmed = F.col("issue_nature").isin("Confirmed Invalid", "Rule Violation") & (F.col("confidence") == "High")
    return findings.withColumn("verification_status", F.when(confirmed, "confirmed_error").otherwise("needs_review"))


def with_class(findings: DataFrame) -> DataFrame:
    """``result_class``, the one layer that a finding is shown in."""
    status = F.col("verification_status")
    found = F.when(~actionable(), CLASSES[3]).when(status == "confirmed_error", CLASSES[0]).when(status == "static_risk", CLASSES[1]).otherwise(CLASSES[2])
    return findings.withColumn("result_class", found)


def with_ids(findings: DataFrame, *identity: str) -> DataFrame:
    """``id``: a digest of the identity columns, with a running number from the second finding of
    the same identity on."""
    digest = F.substring(F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256), 1, 16)
    n = F.row_number().over(Window.partitionBy("_digest").orderBy(*identity))
    out = findings.withColumn("_digest", digest).withColumn("_n", n)
    return out.withColumn("id", F.concat(F.lit("F-"), "_digest", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""))).drop("_digest", "_n")


def problems(findings: DataFrame, key: Column) -> DataFrame:
    """(problem, result_class, n): findings of one event are one problem, in its strongest class."""
    order = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("result_class"))
    grouped = findings.groupBy(key.alias("problem")).agg(F.min(order).alias("k"), F.count("*").alias("n"))
    return grouped.select("problem", F.element_at(F.array(*map(F.lit, CLASSES)), F.col("k").cast("int")).alias("result_class"), "n")


def _weight(weights: Mapping[str, float]) -> Column:
    return F.coalesce(*(F.when(F.col("severity") == s, F.lit(w)) for s, w in weights.items()), F.lit(weights["Low"]))


def rule_penalties(findings: DataFrame, weights: Mapping[str, float], step: float, most: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, category, rule_id, occurrences, penalty): the first finding of a rule weighs in full,
    each further one ``step`` more, up to ``most``."""
    grouped = findings.where(actionable()).groupBy(*by, "category", "rule_id").agg(F.max(_weight(weights)).alias("w"), F.count("*").alias("occurrences"))
    return grouped.select(*by, "category", "rule_id", "occurrences", (F.col("w") + F.least(F.lit(most), (F.col("occurrences") - 1) * F.lit(step))).alias("penalty"))


def bounded_penalty(findings: DataFrame, weights: Mapping[str, float] = DATA_WEIGHTS, category_cap: float = 10.0, total_cap: float = 35.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, penalty): rule penalties, capped for each category and in all."""
    per = rule_penalties(findings, weights, 0.5, 2.0, by).groupBy(*by, "category").agg(F.least(F.lit(category_cap), F.sum("penalty")).alias("p"))
    return per.groupBy(*by).agg(F.least(F.lit(total_cap), F.coalesce(F.sum("p"), F.lit(0.0))).alias("penalty"))


def quality_score(findings: DataFrame, weights: Mapping[str, float], step: float, most: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, score): 100 less the uncapped rule penalties, not below zero, rounded; one row without
    ``by``.  With it, groups of which no finding counts have no row."""
    apart = tuple(c for c in by if c != "category")
    total = rule_penalties(findings, weights, step, most, apart).groupBy(*by).agg(F.coalesce(F.sum("penalty"), F.lit(0.0)).alias("p"))
    return total.select(*by, F.greatest(F.lit(0.0), F.bround(100 - F.least(F.lit(100.0), "p"))).cast("long").alias("score"))


def report_score(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return quality_score(findings, REPORT_WEIGHTS, 1.0, 3.0, by)


def display_score(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return quality_score(findings, DISPLAY_WEIGHTS, 0.5, 2.0, by)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.where(actionable()).groupBy("severity").agg(F.count("*").alias("n"))


def data_score(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """One row (data_score): the lowest score within each lineage group of files, averaged over
    the groups with equal weight.  ``scores`` (file, score), ``groups`` (node, component)."""
    joined = scores.join(groups, F.col("file") == F.col("node"), "left").withColumn("g", F.coalesce("component", "file"))
    return joined.groupBy("g").agg(F.min("score").alias("low")).agg(F.coalesce(F.bround(F.avg("low")), F.lit(0.0)).cast("long").alias("data_score"))


def evaluate(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, precision, recall) over the reviewed subset.

    ``findings`` (id, rule_id, location, verification_status, severity, evidence); ``truth``
    (truth_id, rule_id, location, verification_status, severities array, evidence).  A truth is
    met by exactly one finding of its rule and location with its status, one of its severities
    and its evidence; findings that are there but don't qualify are false positives.  Findings
    that no truth speaks of aren't judged.
    """
    at = truth.alias("t").join(findings.alias("f"), (F.col("t.rule_id") == F.col("f.rule_id")) & F.col("t.location").eqNullSafe(F.col("f.location")), "left")
    fits = (F.col("t.verification_status") == F.col("f.verification_status")) & F.array_contains("t.severities", F.col("f.severity")) & F.contains("f.evidence", "t.evidence")
    judged = at.select("t.truth_id", F.col("f.id").alias("id"), F.coalesce(fits, F.lit(False)).alias("fits"))
    # of truths that one finding would meet, the first gets it
    hits = judged.where("fits").select("truth_id", "id")
    first = hits.groupBy(F.col("id").alias("_id")).agg(F.min("truth_id").alias("first"))
    good = hits.join(first, F.col("id") == F.col("_id")).groupBy("truth_id").agg(F.count("*").alias("n"), F.bool_and(F.col("truth_id") == F.col("first")).alias("is_first"))
    per = judged.groupBy("truth_id").agg(F.collect_set("id").alias("ids")).join(good, "truth_id", "left")
    met = per.withColumn("met", F.coalesce((F.col("n") == 1) & F.col("is_first"), F.lit(False)))
    wrong = met.where("not met").select(F.explode("ids").alias("id")).distinct()
    table = met.agg(F.count(F.when(F.col("met"), 1)).alias("tp"), F.count(F.when(~F.col("met"), 1)).alias("fn")).crossJoin(wrong.agg(F.count("*").alias("fp")))  # one row each
    return table.select("tp", "fp", "fn", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def macro_average(cases: DataFrame) -> DataFrame:
    """One row (cases, tp, fp, fn, precision, recall, macro_precision, macro_recall) of the counts
    (case, tp, fp, fn) of several cases: over all, and the mean of the cases that have a value."""
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    total = cases.agg(F.count("*").alias("cases"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")), F.avg(precision).alias("macro_precision"), F.avg(recall).alias("macro_recall"))
    return total.select("cases", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), "macro_precision", "macro_recall")


#: Points of a project's code, of its data, and of there being either.
POINTS, PART_POINTS = 35.0, 15
#: Most that one category of code findings costs.
CODE_CATEGORY_CAP = 14.0


def project_score(code_findings: DataFrame, data_scores: DataFrame, groups: DataFrame, code_files: int) -> DataFrame:
    """One row (code_score, data_score, completeness, score): the points of the code less its bounded
    penalties, the mean over lineage groups of the files' lowest scores, and 15 points each for code
    and data being there.  ``data_scores`` (file, score), ``groups`` (node, component)."""
    lost = bounded_penalty(code_findings, CODE_WEIGHTS, CODE_CATEGORY_CAP, POINTS)
    code = lost.select((F.bround(F.lit(POINTS) - F.col("penalty")) if code_files else F.lit(0.0)).cast("long").alias("code_score"))
    there = data_scores.agg((F.count("*") > 0).cast("int").alias("there"))
    both = code.crossJoin(data_score(data_scores, groups)).crossJoin(there)  # one row each
    complete = (F.lit(PART_POINTS if code_files else 0) + PART_POINTS * F.col("there")).cast("long")
    return both.select("code_score", "data_score", complete.alias("completeness"), (F.col("code_score") + F.col("data_score") + complete).alias("score"))


#: Roles of result files, and the rules that such a file breaks by its nature.
RESULT_ROLES = ("model_evaluation_report", "feature_importance_result", "other_analysis_artifact")
RESULT_RULES = (
    "DQ_VERY_SMALL_DATASET", "DQ_HIGH_CORRELATION", "DQ_HIGH_CARDINALITY", "DQ_POTENTIAL_ID", "DQ_POTENTIAL_INDEX_COLUMN",
    "DQ_CONSTANT_COLUMN", "DQ_SINGLE_CATEGORY", "DQ_EXTREME_SKEWNESS", "DQ_POTENTIAL_EXTREME_VALUES", "DQ_DISCRETE_DISTRIBUTION_REVIEW",
)


def by_role(findings: DataFrame, roles: DataFrame) -> DataFrame:
    """``findings`` with the ``role`` of their file, of ``roles`` (file, role): what is in the nature
    of a result file is noted there, and neither counts nor weighs."""
    joined = findings.join(roles.select("file", "role"), "file", "left")
    natural = F.coalesce(F.col("role").isin(*RESULT_ROLES) & F.col("rule_id").isin(*RESULT_RULES), F.lit(False))
    noted = {"severity": F.lit("Low"), "action": F.lit("Informational"), "score_impact": F.lit(0.0), "issue_nature": F.lit("Artifact Observation")}
    return joined.withColumns({c: F.when(natural, x).otherwise(F.col(c)) for c, x in noted.items()})


#: The categories that each view of a table's findings shows.
VIEWS = {
    "outliers": ("Outliers",), "invalid": ("Invalid Values",), "business_rules": ("Business Rules",), "types": ("Type Consistency",),
    "categorical": ("Categorical Quality", "String Quality"), "features": ("Feature Quality",), "missing": ("Missing Values",),
}


def category_view(findings: DataFrame, view: str | tuple[str, ...]) -> DataFrame:
    """The findings of the categories that a view shows, by its name or by these themselves."""
    return findings.where(F.col("category").isin(*(VIEWS[view] if isinstance(view, str) else view)))


def issue_table(findings: DataFrame) -> DataFrame:
    """(Severity, Category, Rule, Column, Count, Rate, Action): what is shown of findings, the severe
    ones first; shares as percentages with one digit."""
    rank = F.array_position(F.array(*map(F.lit, ("High", "Medium", "Low"))), F.col("severity"))
    shown = findings.select(rank.alias("_rank"), F.col("severity").alias("Severity"), F.col("category").alias("Category"), F.col("rule_id").alias("Rule"), F.coalesce("column", F.lit("-")).alias("Column"), F.col("detected_count").alias("Count"), F.format_string("%.1f%%", F.col("detected_rate") * 100).alias("Rate"), F.col("action").alias("Action"))
    return shown.orderBy("_rank", "Category", "Rule", "Column").drop("_rank")


def with_first_issue(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """``findings`` (file, rule_id, …) with ``issue``, the first issue (position, file, rule_id) of
    the same file and rule, null where there is none."""
    first = issues.groupBy("file", "rule_id").agg(F.min("position").alias("issue"))
    return findings.join(first, ["file", "rule_id"], "left")


def is_priority() -> Column:
    """Severe, to be fixed, or a confirmed error."""
    return F.lower("severity").isin("high", "critical") | (F.col("action") == "Fix") | (F.col("verification_status") == "confirmed_error")


def penalty_ranking(penalties: DataFrame) -> DataFrame:
    """Penalties of rules with their rank: the largest first, then by category and rule."""
    return penalties.withColumn("place", F.row_number().over(Window.partitionBy(*[c for c in penalties.columns if c == "file"]).orderBy(F.desc("penalty"), "category", "rule_id")))
