"""The findings of an audit as SQL: every rule's predicate, limits and severities said again over
plain aggregates, for the oracle of the registered audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from quarryline.functions import values as V

_TOKENS = ", ".join(f"'{t}'" for t in V.MISSING_TOKENS)
_BOOLEANS = ", ".join(f"'{t}'" for t in V.BOOLEAN_TOKENS)
_TARGETS = ", ".join(f"'{t}'" for t in V.TARGET_NAMES)
_FAR = "(kind = 'continuous numeric')"


def _rule(rule: str, category: str, source: str, where: str, severity: str, count: str, rate: str, confidence: str = "'High'", action: str = "'Review'", impact: str = "NULL", nature: str = "Needs Review", column: str = "c") -> str:
    return f"""SELECT '{rule}' AS rule_id, '{category}' AS category, {column} AS "column", {severity} AS severity, {confidence} AS confidence, ({count})::BIGINT AS detected_count, ROUND({rate}, 6)::DOUBLE AS detected_rate, {action} AS action, ({impact})::DOUBLE AS score_impact, '{nature}' AS issue_nature FROM {source} WHERE {where}"""


def _by(rate: str, medium: float, high: float | None = None) -> str:
    return f"CASE {f'WHEN {rate} >= {high} THEN {chr(39)}High{chr(39)} ' if high else ''}WHEN {rate} >= {medium} THEN 'Medium' ELSE 'Low' END"


_INFO = {"action": "'Informational'", "impact": "0.0"}


def audit_sql(source: str, numeric: Sequence[str], texts: Sequence[str], allowed: Mapping[str, Sequence[str]] | None = None, bounds: Mapping[str, tuple[float | None, float | None]] | None = None, mixed: Mapping[str, str] | None = None) -> str:
    """All findings of the table that ``source`` selects, but for their evidence; ``numeric`` and
    ``texts`` are its columns.  ``mixed`` has an expression of each value's type for columns of texts
    that stand for values of any type."""
    columns = [*numeric, *texts]
    each = lambda form, of: " UNION ALL ".join(form.format(c=c) for c in of)
    no_facts = "SELECT NULL AS c, 0 AS n, 0 AS k, 0.0 AS low, false AS whole, false AS zero_one, 0.0 AS skew, 0.0 AS q1, 0.0 AS q2, 0.0 AS q3, 0 AS negative LIMIT 0"
    low = {c: b[0] for c, b in (bounds or {}).items()}
    high = {c: b[1] for c, b in (bounds or {}).items()}
    outside = lambda c: " OR ".join([f"{c} < {low.get(c)}"] * (low.get(c) is not None) + [f"{c} > {high.get(c)}"] * (high.get(c) is not None)) or "false"
    with_ = [
        f"t AS ({source})",
        "r AS (SELECT COUNT(*) AS n FROM t)",
        f"""nulls AS ({each("SELECT '{c}' AS c, COUNT(*) - COUNT({c}) AS k, (COUNT(*) - COUNT({c})) / COUNT(*) AS p FROM t", columns)})""",
        f"""v AS ({each("SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 2", columns)})""",
        "kinds AS (SELECT c, SUM(n) AS filled, COUNT(*) AS k, MAX(n) AS top FROM v GROUP BY 1)",
        f"""s AS ({each("SELECT '{c}' AS c, REGEXP_REPLACE(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g') AS value, COUNT(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 2", texts) or "SELECT NULL AS c, NULL AS value, 0 AS n LIMIT 0"})""",
        "skinds AS (SELECT c, COUNT(*) AS k FROM s GROUP BY 1)",
        f"solid AS (SELECT c, COUNT(*) AS k FROM s WHERE value <> '' AND LOWER(value) NOT IN ({_TOKENS}) GROUP BY 1)",
        f"""cells AS ({each("SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS raw FROM t WHERE {c} IS NOT NULL", texts) or "SELECT NULL AS c, NULL AS raw LIMIT 0"})""",
        "stripped AS (SELECT c, raw, REGEXP_REPLACE(raw, '^\\s+|\\s+$', '', 'g') AS x FROM cells)",
        f"marked AS (SELECT *, x <> '' AND LOWER(x) NOT IN ({_TOKENS}) AS real FROM stripped)",
        f"""m AS (SELECT c, COUNT(*) AS n, COUNT(*) FILTER (x = '') AS blank, COUNT(*) FILTER (real) AS solid, COUNT(*) FILTER (real AND TRY_CAST(x AS DOUBLE) IS NOT NULL) AS numbers, COUNT(*) FILTER (real AND REGEXP_MATCHES(raw, '{V.DATE_PATTERN}')) AS dated,
COUNT(*) FILTER (real AND REGEXP_MATCHES(x, '{V.DATE_PATTERN}') AND TRY_CAST(x AS TIMESTAMP) IS NOT NULL) AS dates, COUNT(*) FILTER (raw <> x) AS spaced, COUNT(*) FILTER (LENGTH(raw) > 10000) AS lengthy FROM marked GROUP BY 1)""",
        f"""f AS ({each("SELECT '{c}' AS c, COUNT({c}) AS n, COUNT(DISTINCT {c}) AS k, MIN({c})::DOUBLE AS low, COALESCE(BOOL_AND(ABS({c} - ROUND({c})) < 1e-9), false) AS whole, COALESCE(BOOL_AND({c} IN (0, 1)), true) AS zero_one, SKEWNESS({c}) AS skew, QUANTILE_CONT({c}::DOUBLE, 0.25) AS q1, QUANTILE_CONT({c}::DOUBLE, 0.5) AS q2, QUANTILE_CONT({c}::DOUBLE, 0.75) AS q3, COUNT(*) FILTER ({c} < 0) AS negative FROM t", numeric) or no_facts})""",
        f"""kind AS (SELECT *, CASE WHEN k <= 2 AND zero_one THEN 'binary' WHEN whole AND n > 0 AND low >= 0 AND k <= 20 AND (REGEXP_MATCHES(REGEXP_REPLACE(LOWER(c), '[^a-z0-9]+', '_', 'g'), 'count|times?|number|num|visits?|years?|months?') OR k / n <= 0.10) THEN 'count-like'
WHEN k <= 10 AND k / n <= 0.05 THEN 'low-cardinality numeric categorical' WHEN whole AND k <= 20 AND k / n <= 0.10 THEN 'discrete integer' ELSE 'continuous numeric' END AS kind FROM f)""",
        f"""away AS ({each("SELECT '{c}' AS c, MEDIAN(ABS({c}::DOUBLE - (SELECT q2 FROM f WHERE c = '{c}'))) AS mad FROM t", numeric) or "SELECT NULL AS c, 0.0 AS mad LIMIT 0"})""",
        "fence AS (SELECT kind.c, CASE WHEN n < 20 THEN NULL WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) WHEN mad > 0 THEN q2 - 3.5 * mad / 0.6745 END AS lo, CASE WHEN n < 20 THEN NULL WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) WHEN mad > 0 THEN q2 + 3.5 * mad / 0.6745 END AS hi FROM kind JOIN away USING (c))",
        f"""far AS ({each("SELECT '{c}' AS c, COUNT(*) FILTER ({c} < lo OR {c} > hi) AS far FROM t, fence WHERE c = '{c}' GROUP BY 1", numeric) or "SELECT NULL AS c, 0 AS far LIMIT 0"})""",
        f"""bad AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, COUNT(*) FILTER ({outside(c)}) AS bad, {'true' if (low.get(c) or -1) >= 0 or low.get(c) == 0 else 'false'} AS stated FROM t" for c in numeric) or "SELECT NULL AS c, 0 AS bad, false AS stated LIMIT 0"})""",
        "num AS (SELECT * FROM kind JOIN far USING (c) JOIN bad USING (c))",
        f"""ints AS ({each("SELECT '{c}' AS c, {c}::DOUBLE AS x, COUNT(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 2", numeric) or "SELECT NULL AS c, 0.0 AS x, 0 AS n LIMIT 0"})""",
        "common AS (SELECT i.c, x, i.n, f.n AS total, GREATEST(3, CEIL(f.n * 0.01)) AS support FROM ints i JOIN f USING (c) WHERE f.n >= 50 AND whole AND k BETWEEN 4 AND 20)",
        "steps AS (SELECT *, x - LAG(x) OVER (PARTITION BY c ORDER BY x) AS step FROM common WHERE n >= support)",
        "domains AS (SELECT c, MIN(x) AS lo, MAX(x) AS hi FROM steps GROUP BY 1 HAVING COUNT(*) >= 2 AND BOOL_AND(step IS NULL OR step = 1) AND SUM(n) / MAX(total) >= 0.95)",
        "strays AS (SELECT common.c, SUM(n) AS k, MAX(total) AS total FROM common JOIN domains USING (c) WHERE n < support AND (x < lo OR x > hi) GROUP BY 1)",
        f"dup AS (SELECT SUM(n - 1) AS k, SUM(n - 1) / SUM(n) AS p FROM (SELECT COUNT(*) AS n FROM t GROUP BY {', '.join(columns)}))",
    ]
    index = "(LOWER(TRIM(c)) = 'index' OR STARTS_WITH(LOWER(TRIM(c)), 'unnamed:'))"
    named = f"REGEXP_MATCHES(REGEXP_REPLACE(REGEXP_REPLACE(LOWER(TRIM(c)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '{V.IDENTIFIER_NAME}')"
    half = "COALESCE((SELECT k FROM solid WHERE solid.c = m.c), 0) / (SELECT n FROM r)"
    identifier = f"{named} AND {half} >= 0.50 AND numbers > 0 AND numbers < solid"
    size, ratio, kinds = "(SELECT n FROM r)", "numbers / NULLIF(solid, 0)", "m JOIN skinds USING (c)"
    parts = [
        _rule("DQ_VERY_SMALL_DATASET", "Structure", "r", f"n < 20 OR {len(columns)} >= n", "'Low'", "n", f"{len(columns)} / n", column="NULL"),
        _rule("DQ_MISSING_VALUES", "Missing Values", "nulls", "k > 0", _by("p", 0.10, 0.50), "k", "p", nature="Missing Data"),
        _rule("DQ_ALL_NULL_COLUMN", "Feature Quality", "nulls", "p = 1", "'Medium'", "k", "1.0"),
        _rule("DQ_CONSTANT_COLUMN", "Feature Quality", "kinds", "k = 1", "'Low'", "filled", "1.0"),
        _rule("DQ_NEAR_CONSTANT_COLUMN", "Feature Quality", "kinds", "k > 1 AND top / filled >= 0.99", "'Low'", "top", "top / filled"),
        _rule("DQ_POTENTIAL_INDEX_COLUMN", "Structure", "kinds", f"{index} AND k / filled >= 0.98", "'Low'", "k", "k / filled", "'Medium'", nature="Potential Identifier"),
        _rule("DQ_POTENTIAL_TARGET", "Target Quality", "kinds", f"LOWER(TRIM(c)) IN ({_TARGETS}) AND k > 1 AND k <= LEAST(20, GREATEST(2, CEIL({size} * 0.10)))", "'Low'", "k", f"k / {size}", "'Medium'"),
        _rule("DQ_POTENTIAL_CLASS_IMBALANCE", "Target Quality", "kinds", f"LOWER(TRIM(c)) IN ({_TARGETS}) AND k > 1 AND k <= LEAST(20, GREATEST(2, CEIL({size} * 0.10))) AND top / filled >= 0.90", "'Medium'", "top", "top / filled", "'Medium'"),
        _rule("DQ_DUPLICATE_ROWS", "Duplicates", "dup", "k > 0", _by("p", 0.01, 0.10), "k", "p", column="NULL"),
        _rule("DQ_SUSPECTED_MISSING_TOKEN", "Missing Values", f"(SELECT c, LOWER(value) AS token, SUM(n) AS k FROM s WHERE LOWER(value) IN ({_TOKENS}) GROUP BY 1, 2)", "true", "'Low'", "k", f"k / {size}", "'Medium'"),
        _rule("DQ_CATEGORY_CASE", "String Quality", "(SELECT c, COUNT(*) AS k FROM (SELECT c, LOWER(value) FROM s GROUP BY 1, 2 HAVING COUNT(*) > 1) GROUP BY 1)", "true", "'Low'", "k", "NULL::DOUBLE"),
        _rule("DQ_BOOLEAN_ENCODING", "Type Consistency", f"(SELECT c, COUNT(DISTINCT LOWER(value)) AS k, COUNT(DISTINCT LOWER(value)) FILTER (value IN ('0', '1')) AS digits, BOOL_AND(LOWER(value) IN ({_BOOLEANS})) AS all_of FROM s GROUP BY 1)", "all_of AND digits > 0 AND k > digits", "'Low'", "k", "NULL::DOUBLE", "'Medium'"),
        _rule("DQ_BLANK_STRING", "Missing Values", "m", "blank > 0", _by("blank / n", 0.10), "blank", f"blank / {size}"),
        _rule("DQ_IDENTIFIER_REPRESENTATION", "Feature Quality", "m", identifier, "'Low'", "solid", half, "'Medium'", **_INFO, nature="Potential Identifier"),
        _rule("DQ_NUMERIC_PARSE_ANOMALY", "Type Consistency", "m", f"solid > 0 AND NOT ({identifier}) AND {ratio} >= 0.80 AND {ratio} < 1", "'Medium'", "solid - numbers", "(solid - numbers) / NULLIF(solid, 0)", action="'Fix'"),
        _rule("DQ_MIXED_REPRESENTATION", "Type Consistency", "m", f"solid > 0 AND NOT ({identifier}) AND {ratio} >= 0.20 AND {ratio} < 0.80 AND numbers >= 3 AND solid - numbers >= 3", "'Medium'", "solid - numbers", "(solid - numbers) / NULLIF(solid, 0)", "'Medium'"),
        _rule("DQ_DATETIME_PARSE_ANOMALY", "Type Consistency", "m", "solid > 0 AND dated >= GREATEST(3, CEIL(solid * 0.8)) AND dates / NULLIF(solid, 0) >= 0.80 AND dates < solid", "'Medium'", "solid - dates", "1 - dates / NULLIF(solid, 0)", action="'Fix'"),
        _rule("DQ_SURROUNDING_WHITESPACE", "String Quality", "m", "spaced > 0", "'Low'", "spaced", "spaced / n"),
        _rule("DQ_EXCESSIVE_TEXT", "String Quality", "m", "lengthy > 0", "'Low'", "lengthy", "lengthy / n"),
        _rule("DQ_SINGLE_CATEGORY", "Categorical Quality", kinds, "k = 1", "'Low'", "n", "1.0"),
        _rule("DQ_HIGH_CARDINALITY", "Categorical Quality", kinds, f"{size} >= 20 AND k / {size} >= 0.90", "'Low'", "k", f"k / {size}", "'Medium'", f"CASE WHEN {named} THEN 'Informational' ELSE 'Review' END", f"CASE WHEN {named} THEN 0.0 END"),
        _rule("DQ_POTENTIAL_ID", "Feature Quality", kinds, f"{size} >= 20 AND k / {size} >= 0.98", "'Low'", "k", f"k / {size}", "'Medium'", **_INFO, nature="Potential Identifier"),
        _rule("DQ_RARE_CATEGORIES", "Categorical Quality", f"(SELECT m.c, k, (SELECT SUM(s.n) FROM s WHERE s.c = m.c AND s.n / {size} < 0.01) AS rare FROM {kinds})", f"{size} >= 100 AND k > 1 AND k <= 100 AND rare > 0", "'Low'", "rare", f"rare / {size}", "'Medium'", action="'Informational'"),
        _rule("DQ_POTENTIAL_CATEGORICAL_DOMAIN_VIOLATION", "Categorical Quality", "strays", f"c NOT IN ({', '.join(f'{chr(39)}{c}{chr(39)}' for c in (allowed or {})) or 'NULL' if allowed else chr(39) * 2})", "'Medium'", "k", "k / total", "'Medium'", **_INFO, nature="Distribution Review"),
        _rule("DQ_EXTREME_SKEWNESS", "Numeric Quality", "num", f"{_FAR} AND n >= 20 AND ABS(skew) >= 3", "'Low'", "n", "NULL::DOUBLE", "'Medium'", action="'Informational'"),
        _rule("DQ_POTENTIAL_EXTREME_VALUES", "Outliers", "num", f"far > 0 AND {_FAR}", _by("far / n", 0.10), "far", "far / n", "'Medium'", **_INFO, nature="Statistical Anomaly"),
        _rule("DQ_DISCRETE_DISTRIBUTION_REVIEW", "Outliers", "num", f"far > 0 AND NOT {_FAR}", "'Low'", "far", "far / n", "'Low'", **_INFO, nature="Distribution Review"),
        _rule("DQ_CONSTRAINT_VIOLATION", "Invalid Values", "num", "bad > 0", "CASE WHEN bad / n >= 0.10 THEN 'High' ELSE 'Medium' END", "bad", "bad / n", action="'Fix'", nature="Rule Violation"),
        _rule("DQ_POTENTIAL_NON_NEGATIVE_VIOLATION", "Business Rules", "num", f"negative > 0 AND NOT stated AND REGEXP_MATCHES(REPLACE(LOWER(TRIM(c)), ' ', '_'), '{V.NON_NEGATIVE_NAME}')", "'Medium'", "negative", "negative / n", "'Medium'", nature="Potential Business Rule"),
    ]
    for c, values in (allowed or {}).items():
        quoted = ", ".join(f"'{x}'" for x in values)
        parts.append(_rule("DQ_CONSTRAINT_VIOLATION", "Invalid Values", f"(SELECT '{c}' AS c, COUNT(*) FILTER ({c} NOT IN ({quoted})) AS k, COUNT({c}) AS n FROM t)", "k > 0", "CASE WHEN k / n >= 0.10 THEN 'High' ELSE 'Medium' END", "k", "k / n", action="'Fix'", nature="Rule Violation"))
    for c, kind in (mixed or {}).items():
        parts.append(_rule("DQ_MIXED_PYTHON_TYPES", "Type Consistency", f"(SELECT '{c}' AS c, COUNT(DISTINCT {kind}) AS k FROM t WHERE {c} IS NOT NULL)", "k > 1", "'Medium'", "k", "NULL::DOUBLE"))
    for of in (numeric, texts):
        for a, b in combinations(of, 2):
            parts.append(_rule("DQ_IDENTICAL_COLUMNS", "Feature Quality", f"(SELECT '{a} / {b}' AS c, COUNT(*) AS n FROM t HAVING TYPEOF(ANY_VALUE({a})) = TYPEOF(ANY_VALUE({b})) AND COUNT(*) FILTER ({a} IS DISTINCT FROM {b}) = 0)", "true", "'Medium'", "n", "1.0"))
    for a, b in combinations(numeric, 2):
        parts.append(_rule("DQ_HIGH_CORRELATION", "Correlation", f"(SELECT '{a} / {b}' AS c, ABS(CORR({a}::DOUBLE, {b}::DOUBLE)) AS p FROM t)", "ISFINITE(p) AND p >= 0.95", "'Low'", "NULL", "p", **_INFO))
    return "WITH " + ",\n".join(with_) + "\n" + "\nUNION ALL ".join(parts)
