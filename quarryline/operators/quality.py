"""Data-quality rules: the aggregates of a table judged into a findings table.

Every rule reads aggregates that Spark makes in a handful of passes (null counts, value counts,
text metrics, numeric facts, fences, correlations); what reaches the driver is one small row for
each column.  A finding is (rule_id, category, column, severity, confidence, detected_count, detected_rate, action,
score_impact, issue_nature, evidence).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import values as V
from quarryline.operators import profile as P
from quarryline.operators.duplicates import duplicate_summary, identical_columns
from quarryline.operators.outliers import fences_of, integer_domains
from quarryline.operators.overlap import best_candidate, identifier_candidates, overlap_summary
from quarryline.sources.scratch import written

FINDINGS = "rule_id string, category string, column string, severity string, confidence string, detected_count bigint, detected_rate double, action string, score_impact double, issue_nature string, evidence string"

#: Limits of the rules.
SMALL_ROWS, NEAR_CONSTANT, HIGH_CORRELATION = 20, 0.99, 0.95
HIGH_CARDINALITY, POTENTIAL_ID, RARE_SHARE, RARE_ROWS, RARE_KINDS = 0.90, 0.98, 0.01, 100, 100
PARSED, MIXED, LONG_TEXT, SKEWED = 0.80, 0.20, 10_000, 3


def _finding(rule: str, category: str, column: str | None, severity: str, confidence: str, count: int | None = None, rate: float | None = None, action: str = "Review", info: bool = False, nature: str = "Needs Review", evidence: str = "") -> tuple:
    return (rule, category, column, severity, confidence, count, rate, "Informational" if info else action, 0.0 if info else None, nature, evidence)


def _severity(rate: float, medium: float, high: float) -> str:
    return "High" if rate >= high else "Medium" if rate >= medium else "Low"


def model_status(column: str, flow: Mapping | None) -> str:
    """Included or Excluded where the recorded flow proves it, else Unknown."""
    features, excluded = set((flow or {}).get("model_features", [])), set((flow or {}).get("excluded_features", []))
    if column in features:
        return "Included"
    return "Excluded" if column in excluded or features else "Unknown"


def normal_name(column: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", column.strip().casefold()).strip("_")


def _is_index(column: str) -> bool:
    name = column.strip().casefold()
    return name == "index" or name.startswith("unnamed:")


#: Fixed value: names of models to which columns that go together are a problem.
COLLINEAR_MODELS = r"(?i)(?:linear|logistic|ridge|lasso|elastic|svm|svc|svr)"


def correlation_matters(a: str, b: str, flow: Mapping | None) -> bool:
    """Do both columns go into the model, and is one of the recorded models sensitive to it?"""
    models = [m if isinstance(m, str) else m.get("type") or "" for m in (flow or {}).get("models", [])]
    return {model_status(a, flow), model_status(b, flow)} == {"Included"} and any(re.search(COLLINEAR_MODELS, m) for m in models)


def text_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, blank, meaningful, numeric, dated, parsed_dates, spaced, long): counts over the
    text of each non-numeric column, all in one pass."""

    def count_if(condition):  # noqa: ANN001, ANN202
        return F.count(F.when(condition, 1))

    def text(c: str):  # noqa: ANN202
        return F.col(c).cast("string")

    def meaningful(c: str):  # noqa: ANN202
        s = V.strip(text(c))
        return (s != "") & ~V.is_missing_token(s)

    return P._chunked(
        df,
        list(columns),
        {
            "n": lambda c: F.count(text(c)),
            "blank": lambda c: count_if(V.strip(text(c)) == ""),
            "meaningful": lambda c: count_if(meaningful(c)),
            "numeric": lambda c: count_if(meaningful(c) & V.number_in(V.strip(text(c))).isNotNull()),
            "dated": lambda c: count_if(meaningful(c) & text(c).rlike(V.DATE_PATTERN)),
            "parsed_dates": lambda c: count_if(meaningful(c) & V.date_in(V.strip(text(c))).isNotNull()),
            "spaced": lambda c: count_if(text(c) != V.strip(text(c))),
            "long": lambda c: count_if(F.char_length(text(c)) > LONG_TEXT),
        },
    )


def text_metrics_of(counts: DataFrame) -> DataFrame:
    """:func:`text_metrics` of the value counts (column, value, n) of texts as they are: what is asked of
    a text is asked once, however often it occurs."""
    x = F.col("value")
    s = V.strip(x)
    marked = counts.select("column", "value", "n", s.alias("s"), ((s != "") & ~V.is_missing_token(s)).alias("real"))

    def count_if(condition):  # noqa: ANN001, ANN202
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return marked.groupBy("column").agg(
        F.sum("n").alias("n"),
        count_if(F.col("s") == "").alias("blank"),
        count_if(F.col("real")).alias("meaningful"),
        count_if(F.col("real") & V.number_in(F.col("s")).isNotNull()).alias("numeric"),
        count_if(F.col("real") & x.rlike(V.DATE_PATTERN)).alias("dated"),
        count_if(F.col("real") & V.date_in(F.col("s")).isNotNull()).alias("parsed_dates"),
        count_if(x != F.col("s")).alias("spaced"),
        count_if(F.char_length("value") > LONG_TEXT).alias("long"),
    )


def representations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kinds): what the texts of each column spell, as far as they do: whole number, number,
    boolean, date or text.  A column of more than one kind holds values of mixed types."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), V.strip(F.col(c).cast("string")).alias("x")) for c in columns)))
    x = F.col("x")
    kind = F.when(x.rlike(r"^[+-]?\d+$"), "whole number").when(V.number_in(x).isNotNull(), "number").when(F.lower(x).isin("true", "false"), "boolean").when(x.rlike(V.DATE_PATTERN) & V.date_in(x).isNotNull(), "date").otherwise("text")
    found = df.select(cells.alias("c")).select("c.*").where("x <> ''").groupBy("column", kind.alias("kind")).agg(F.count("*").alias("n"))
    return found.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), F.sum("n").alias("n"))


#: The kinds of values in a VARIANT column, by the beginnings of their types.
VARIANT_KINDS = {"BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "bool", "STRING": "str", "OBJECT": "dict", "ARRAY": "list", "DATE": "date", "TIMESTAMP": "datetime", "BINARY": "bytes"}


def variant_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() == "variant"]


def value_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, types, n): the different types of the values of VARIANT columns, sorted, and how many
    values there are; nulls, and nulls of JSON, are no values.  The type is each value's own, not
    what its text may spell."""

    def kind(c: str):  # noqa: ANN202
        schema = F.schema_of_variant(c)
        return F.when(F.col(c).isNotNull() & ~F.is_variant_null(c), F.coalesce(*(F.when(schema.startswith(t), k) for t, k in VARIANT_KINDS.items()), schema))

    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), kind(c).alias("kind")) for c in columns)))
    found = df.select(cells.alias("c")).select("c.*").where("kind is not null").groupBy("column", "kind").agg(F.count("*").alias("n"))
    return found.groupBy("column").agg(F.sort_array(F.collect_list("kind")).alias("types"), F.sum("n").alias("n"))


def stripped_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of the stripped texts."""
    return P.value_counts(df.select(*(V.strip(F.col(c).cast("string")).alias(c) for c in columns)), columns)


def missing_tokens(counts: DataFrame) -> DataFrame:
    """(column, token, n) of stripped value counts: one row for each token that stands for missing."""
    return counts.where(V.is_missing_token(F.col("value"))).groupBy("column", F.lower("value").alias("token")).agg(F.sum("n").alias("n"))


def case_variants(counts: DataFrame) -> DataFrame:
    """(column, folded, spellings): texts that occur in several spellings of upper and lower case."""
    return counts.groupBy("column", V.case_fold(F.col("value")).alias("folded")).agg(F.count("*").alias("spellings")).where("spellings > 1")


def rare_values(counts: DataFrame, rows: int, share: float = RARE_SHARE) -> DataFrame:
    """(column, value, n) of the values below ``share`` of all rows."""
    return counts.where(F.col("n") / rows < share)


def boolean_encodings(counts: DataFrame) -> DataFrame:
    """(column, tokens): columns that hold boolean words only, and mix digits with words."""
    per = counts.groupBy("column").agg(F.bool_and(F.lower("value").isin(*V.BOOLEAN_TOKENS)).alias("boolean"), F.sort_array(F.collect_set(F.when(F.lower("value").isin(*V.BOOLEAN_TOKENS), F.lower("value")))).alias("tokens"))
    digits = F.array(F.lit("0"), F.lit("1"))
    return per.where("boolean").where(F.arrays_overlap("tokens", digits) & (F.size(F.array_except("tokens", digits)) > 0)).select("column", "tokens")


def sequential(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """One row (sequential boolean): is the column 0, 1, 2, … in the order of the row ids?"""
    same = F.coalesce(F.col(column).cast("double") == F.col(row_id).cast("double"), F.lit(False))
    return df.agg((F.coalesce(F.bool_and(same), F.lit(False))).alias("sequential"))


def header_duplicates(header: Sequence[str]) -> list[tuple[str, int]]:
    return [(name, n) for name, n in Counter(header).items() if n > 1]


def domain_violations(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """The rows whose value is set and not among ``allowed``."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))


def range_violations(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The rows whose finite value is below ``low`` or above ``high``."""
    x = V.finite(F.col(column))
    return df.where(F.coalesce(x < low if low is not None else F.lit(False), F.lit(False)) | F.coalesce(x > high if high is not None else F.lit(False), F.lit(False)))


def audit(df: DataFrame, constraints: Mapping[str, Mapping] | None = None, flow: Mapping | None = None, header: Sequence[str] | None = None, row_id: str | None = None) -> DataFrame:
    """The findings of all rules over one table.

    ``constraints``: column -> {min, max, non_negative, allowed_values or categories}.  ``row_id``
    names a column of 0-based positions, which is itself not audited.  The values of VARIANT columns
    may be of mixed types, which is a finding; all other rules take them as texts.
    """
    spark = df.sparkSession
    data = df.drop(row_id) if row_id else df
    variants = variant_columns(data)
    types = value_types(data, variants).where(F.size("types") > 1).collect() if variants else []  # one row a column
    data = data.withColumns({c: F.col(c).cast("string") for c in variants}) if variants else data
    constraints = {c: ({"min": 0} if r.get("non_negative") and r.get("min") is None else {}) | dict(r) for c, r in (constraints or {}).items()}
    out: list[tuple] = []
    rows = data.count()
    if not rows or not data.columns:
        return spark.createDataFrame([_finding("DQ_EMPTY_DATASET", "Structure", None, "High", "High", 0, 1.0)], FINDINGS)
    if rows < SMALL_ROWS or len(data.columns) >= rows:
        out.append(_finding("DQ_VERY_SMALL_DATASET", "Structure", None, "Low", "High", rows, len(data.columns) / rows))
    out += [_finding("DQ_DUPLICATE_COLUMN_NAME", "Structure", name, "Medium", "High", n) for name, n in header_duplicates(header or [])]

    for r in types:
        out.append(_finding("DQ_MIXED_PYTHON_TYPES", "Type Consistency", r["column"], "Medium", "High", len(r["types"]), evidence=",".join(r["types"])))
    numeric = P.numeric_columns(data)
    booleans = {f.name for f in data.schema if f.dataType.typeName() == "boolean"}
    texts = [c for c in data.columns if c not in set(numeric) | booleans]
    nulls = {r["column"]: r for r in P.null_profile(data).collect()}
    for c in data.columns:
        n, rate = nulls[c]["nulls"], nulls[c]["null_rate"]
        if n:
            left_out = model_status(c, flow) == "Excluded"
            out.append(_finding("DQ_MISSING_VALUES", "Missing Values", c, "Low" if left_out else _severity(rate, 0.10, 0.50), "High", n, rate, info=left_out, nature="Missing Data"))
        if n == rows:
            out.append(_finding("DQ_ALL_NULL_COLUMN", "Feature Quality", c, "Medium", "High", rows, 1.0))

    plain = data.select(*(F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in data.dtypes))
    for r in P.dominance(plain, data.columns).collect():  # a row a column
        c, share = r["column"], (r["top_count"] or 0) / r["non_null"]
        if r["constant"]:
            out.append(_finding("DQ_CONSTANT_COLUMN", "Feature Quality", c, "Low", "High", r["non_null"], 1.0))
        elif share >= NEAR_CONSTANT:
            out.append(_finding("DQ_NEAR_CONSTANT_COLUMN", "Feature Quality", c, "Low", "High", r["top_count"], share))
    # the values themselves are only counted in columns whose names ask for it
    named = [c for c in data.columns if _is_index(c) or c.strip().casefold() in V.TARGET_NAMES]
    kinds = {r["column"]: r for r in P.cardinality(P.value_counts(plain, named)).collect()} if named else {}
    for c, r in kinds.items():
        name = c.strip().casefold()
        if _is_index(c):
            ordered = bool(row_id) and sequential(df, c, row_id).first()["sequential"]
            if ordered or r["unique_ratio"] >= POTENTIAL_ID:
                out.append(_finding("DQ_POTENTIAL_INDEX_COLUMN", "Structure", c, "Low", "High" if ordered else "Medium", r["n_distinct"], r["unique_ratio"], info=model_status(c, flow) == "Excluded", nature="Potential Identifier"))
        if name in V.TARGET_NAMES and 1 < r["n_distinct"] <= min(20, max(2, ceil(rows * 0.10))):
            out.append(_finding("DQ_POTENTIAL_TARGET", "Target Quality", c, "Low", "Medium", r["n_distinct"], r["n_distinct"] / rows))
            if r["dominant_rate"] >= 0.90:
                out.append(_finding("DQ_POTENTIAL_CLASS_IMBALANCE", "Target Quality", c, "Medium", "Medium", r["top_count"], r["dominant_rate"]))

    for c, rule in constraints.items():
        allowed = rule.get("allowed_values", rule.get("categories"))
        if c in data.columns and allowed is not None:
            n, of = domain_violations(data, c, list(allowed)).count(), rows - nulls[c]["nulls"]
            if n:
                out.append(_finding("DQ_CONSTRAINT_VIOLATION", "Invalid Values", c, "High" if n / of >= 0.10 else "Medium", "High", n, n / of, "Fix", nature="Rule Violation"))

    dup = duplicate_summary(data).first()
    if dup["duplicate_rows"]:
        out.append(_finding("DQ_DUPLICATE_ROWS", "Duplicates", None, _severity(dup["duplicate_rate"], 0.01, 0.10), "High", dup["duplicate_rows"], dup["duplicate_rate"]))
    for r in identical_columns(data).collect():
        out.append(_finding("DQ_IDENTICAL_COLUMNS", "Feature Quality", f"{r['left']} / {r['right']}", "Medium", "High", rows, 1.0))

    out += _text_rules(data, texts, rows, flow) if texts else []
    out += _numeric_rules(data, numeric, rows, constraints, flow) if numeric else []
    return spark.createDataFrame(out, FINDINGS)


def _text_rules(data: DataFrame, texts: list[str], rows: int, flow: Mapping | None) -> list[tuple]:
    out = []
    raw = written(P.value_counts(data, texts), "value-counts")
    counts = written(raw.groupBy("column", V.strip(F.col("value")).alias("value")).agg(F.sum("n").alias("n")), "stripped-counts")
    meaningful = {r["column"]: r["k"] for r in counts.where((F.col("value") != "") & ~V.is_missing_token(F.col("value"))).groupBy("column").agg(F.count("*").alias("k")).collect()}
    kinds = {r["column"]: r for r in P.cardinality(counts).collect()}
    for r in missing_tokens(counts).collect():
        out.append(_finding("DQ_SUSPECTED_MISSING_TOKEN", "Missing Values", r["column"], "Low", "Medium", r["n"], r["n"] / rows, evidence=f"token={r['token']}"))
    for r in case_variants(counts).groupBy("column").agg(F.count("*").alias("n")).collect():
        out.append(_finding("DQ_CATEGORY_CASE", "String Quality", r["column"], "Low", "High", r["n"]))
    for r in boolean_encodings(counts).collect():
        out.append(_finding("DQ_BOOLEAN_ENCODING", "Type Consistency", r["column"], "Low", "Medium", len(r["tokens"]), evidence=",".join(r["tokens"])))
    rare = {r["column"]: r["n"] for r in rare_values(counts, rows).groupBy("column").agg(F.sum("n").alias("n")).collect()}
    for r in text_metrics_of(raw).collect():  # a row a column
        c, n, m = r["column"], r["n"], r["meaningful"]
        if not n:
            continue
        status, named = model_status(c, flow), bool(re.search(V.IDENTIFIER_NAME, normal_name(c)))
        if r["blank"]:
            out.append(_finding("DQ_BLANK_STRING", "Missing Values", c, "Medium" if r["blank"] / n >= 0.10 else "Low", "High", r["blank"], r["blank"] / rows))
        if m:
            ratio, failed = r["numeric"] / m, m - r["numeric"]
            if named and meaningful.get(c, 0) / rows >= 0.50 and 0 < ratio < 1:
                out.append(_finding("DQ_IDENTIFIER_REPRESENTATION", "Feature Quality", c, "Low", "Medium", m, meaningful.get(c, 0) / rows, info=True, nature="Potential Identifier"))
            elif PARSED <= ratio < 1:
                out.append(_finding("DQ_NUMERIC_PARSE_ANOMALY", "Type Consistency", c, "Medium", "High", failed, failed / m, "Fix"))
            elif MIXED <= ratio < PARSED and r["numeric"] >= 3 and failed >= 3:
                out.append(_finding("DQ_MIXED_REPRESENTATION", "Type Consistency", c, "Medium", "Medium", failed, failed / m))
            if r["dated"] >= max(3, ceil(m * 0.8)) and PARSED <= r["parsed_dates"] / m < 1:
                out.append(_finding("DQ_DATETIME_PARSE_ANOMALY", "Type Consistency", c, "Medium", "High", m - r["parsed_dates"], 1 - r["parsed_dates"] / m, "Fix"))
        if r["spaced"]:
            out.append(_finding("DQ_SURROUNDING_WHITESPACE", "String Quality", c, "Low", "High", r["spaced"], r["spaced"] / n))
        if r["long"]:
            out.append(_finding("DQ_EXCESSIVE_TEXT", "String Quality", c, "Low", "High", r["long"], r["long"] / n))
        k = kinds[c]["n_distinct"]
        if k == 1:
            out.append(_finding("DQ_SINGLE_CATEGORY", "Categorical Quality", c, "Low", "High", n, 1.0))
        if rows >= SMALL_ROWS and k / rows >= HIGH_CARDINALITY:
            out.append(_finding("DQ_HIGH_CARDINALITY", "Categorical Quality", c, "Low", "Medium", k, k / rows, info=status == "Excluded" or named))
        if rows >= SMALL_ROWS and k / rows >= POTENTIAL_ID:
            out.append(_finding("DQ_POTENTIAL_ID", "Feature Quality", c, "Low", "Medium", k, k / rows, info=status != "Included", nature="Potential Identifier"))
        if rows >= RARE_ROWS and 1 < k <= RARE_KINDS and rare.get(c):
            out.append(_finding("DQ_RARE_CATEGORIES", "Categorical Quality", c, "Low", "Medium", rare[c], rare[c] / rows, action="Informational"))
    return out


def _numeric_rules(data: DataFrame, numeric: list[str], rows: int, constraints: Mapping, flow: Mapping | None = None) -> list[tuple]:
    out = []
    prepared = data.select(*(V.finite(F.col(c)).alias(c) for c in numeric))
    # no rule asks for the number of different values where there are more than a few
    few = P.few_valued(prepared, numeric)
    values = written(P.value_counts(prepared, few) if few else data.sparkSession.createDataFrame([], "column string, value string, n long"), "value-counts")
    facts = {r["column"]: r for r in P.numeric_classes(data, numeric, values, many=[c for c in numeric if c not in few]).collect()}
    rare_integers = {r["column"]: r["n"] for r in integer_domains(values.withColumn("value", F.col("value").cast("double"))).groupBy("column").agg(F.sum("n").alias("n")).collect()}
    skew = {r["column"]: r["skewness"] for r in P.skewness(data, numeric).collect()}
    bounds = fences_of(data, {c: facts[c]["n"] for c in numeric})
    x = {c: V.finite(F.col(c)) for c in numeric}

    def outside(c: str, low: float | None, high: float | None):  # noqa: ANN202
        below, above = (F.lit(False) if low is None else x[c] < low), (F.lit(False) if high is None else x[c] > high)
        return F.count(F.when(below | above, 1))

    # every count of every column in one pass
    counts = data.agg(
        *(
            m
            for i, c in enumerate(numeric)
            for m in (
                F.count(F.when(F.abs(F.col(c).cast("double")) == float("inf"), 1)).alias(f"odd{i}"),
                outside(c, *((bounds[c]["low"], bounds[c]["high"]) if c in bounds else (None, None))).alias(f"far{i}"),
                outside(c, constraints.get(c, {}).get("min"), constraints.get(c, {}).get("max")).alias(f"bad{i}"),
                outside(c, 0, None).alias(f"neg{i}"),
            )
        )
    ).first()
    for i, c in enumerate(numeric):
        f, rule = facts[c], constraints.get(c, {})
        n, continuous = f["n"], f["kind"] == "continuous numeric"
        odd, far, bad, negative = (counts[f"{k}{i}"] for k in ("odd", "far", "bad", "neg"))
        if odd:
            out.append(_finding("DQ_NON_FINITE_NUMERIC", "Invalid Values", c, "High" if odd / rows >= 0.05 else "Medium", "High", odd, odd / rows, "Fix", nature="Confirmed Invalid"))
        if rule.get("allowed_values", rule.get("categories")) is None and n >= 50 and f["integer_like"] and 4 <= (f["n_distinct"] or 0) <= 20:
            rare = rare_integers.get(c)
            if rare:
                out.append(_finding("DQ_POTENTIAL_CATEGORICAL_DOMAIN_VIOLATION", "Categorical Quality", c, "Medium", "Medium", rare, rare / n, info=True, nature="Distribution Review"))
        if continuous and n >= 20 and skew[c] is not None and abs(skew[c]) >= SKEWED:
            out.append(_finding("DQ_EXTREME_SKEWNESS", "Numeric Quality", c, "Low", "Medium", n, evidence=f"skewness={skew[c]:.3f}", action="Informational"))
        if far and continuous:
            out.append(_finding("DQ_POTENTIAL_EXTREME_VALUES", "Outliers", c, "Medium" if far / n >= 0.10 else "Low", "Medium", far, far / n, info=True, nature="Statistical Anomaly", evidence=f"method={bounds[c]['method']}"))
        elif far:
            out.append(_finding("DQ_DISCRETE_DISTRIBUTION_REVIEW", "Outliers", c, "Low", "Low", far, far / n, info=True, nature="Distribution Review", evidence=f"method={bounds[c]['method']}"))
        if bad:
            out.append(_finding("DQ_CONSTRAINT_VIOLATION", "Invalid Values", c, "High" if bad / n >= 0.10 else "Medium", "High", bad, bad / n, "Fix", nature="Rule Violation"))
        stated = rule.get("min") is not None and rule["min"] >= 0
        if negative and not stated and re.search(V.NON_NEGATIVE_NAME, c.strip().casefold().replace(" ", "_")):
            out.append(_finding("DQ_POTENTIAL_NON_NEGATIVE_VIOLATION", "Business Rules", c, "Medium", "Medium", negative, negative / n, nature="Potential Business Rule"))
    if len(numeric) > 1:
        for r in P.correlations(data, numeric).where(F.abs("r") >= HIGH_CORRELATION).collect():
            matters = correlation_matters(r["feature_a"], r["feature_b"], flow)
            out.append(_finding("DQ_HIGH_CORRELATION", "Correlation", f"{r['feature_a']} / {r['feature_b']}", "Low", "High", rate=abs(r["r"]), info=not matters))
    return out


def audit_split(train: DataFrame, test: DataFrame, model_inputs: Sequence[str] = (), entity: Sequence[str] = ()) -> DataFrame:
    """The findings of a split: full rows, model inputs and entities that occur in both parts.

    An entity key is confirmed only where the caller names it; the column that looks most like an
    identifier is otherwise a candidate, and its overlap is less severe.  Equal model inputs are a
    pattern, not a proof of equal records.
    """
    columns, out = train.columns, []
    rows = train.count() + test.count()
    both = train.unionByName(test)
    candidate = [] if entity else [r["column"] for r in best_candidate(identifier_candidates(both)).collect()]
    scopes = (
        ("DQ_CROSS_SPLIT_DUPLICATES", columns, "High", "High", "Confirmed Record Duplication"),
        ("DQ_CROSS_SPLIT_FEATURE_COMBINATIONS", list(model_inputs), "Low", "Medium", "Feature Pattern Reuse"),
        ("DQ_CROSS_SPLIT_CANDIDATE_ID_OVERLAP", candidate, "Medium", "Medium", "Candidate Entity Overlap"),
        ("DQ_CROSS_SPLIT_ENTITY_ID_OVERLAP", list(entity), "High", "High", "Confirmed Entity Overlap"),
    )
    for rule, fields, severity, confidence, nature in scopes:
        if not fields or not set(fields) <= set(columns):
            continue  # what can't be quantified stays unknown
        found = overlap_summary(train, test, fields).first()
        if found["cross_split_duplicate_groups"]:
            n = found["shared_records"]
            out.append(_finding(rule, "Duplicates", ", ".join(fields), severity, confidence, n, n / max(1, rows), nature=nature, evidence=f"groups={found['cross_split_duplicate_groups']}"))
    return train.sparkSession.createDataFrame(out, FINDINGS)
