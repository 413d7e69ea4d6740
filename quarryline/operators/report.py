"""A Markdown report of a findings table; what it shows is bounded whatever the table's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.values import sample_text
from quarryline.operators.findings import actionable, report_score

#: Findings of high and medium severity that a report lists.
SHOWN = 20


def markdown(findings: DataFrame, title: str = "Data quality report", shown: int = SHOWN) -> str:
    """Score, counts by severity, the first severe findings, and the minor ones by category."""
    order = F.when(F.col("severity") == "High", 0).otherwise(1)
    severe = findings.where(actionable() & F.col("severity").isin("High", "Medium"))
    listed = severe.orderBy(order, "rule_id", "column").limit(shown).select("severity", "rule_id", sample_text(F.col("column")).alias("column"), "detected_count").collect()
    counts = {r["severity"]: r["n"] for r in findings.where(actionable()).groupBy("severity").agg(F.count("*").alias("n")).collect()}
    minor = findings.where(actionable() & (F.col("severity") == "Low")).groupBy("category").agg(F.count("*").alias("n")).orderBy("category").limit(shown).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", f"Score: {report_score(findings).first()['score']}/100", ""]
    lines += [f"{s}: {counts.get(s, 0)}" for s in ("High", "Medium", "Low")]
    if listed:
        lines += ["", "| Severity | Rule | Column | Count |", "| --- | --- | --- | --- |", *(f"| {' | '.join(map(cell, r))} |" for r in listed)]
    if minor:
        lines += ["", "Minor findings: " + ", ".join(f"{r['category']} {r['n']}" for r in minor)]
    return "\n".join(lines) + "\n"


def save(result: DataFrame, path: str, form: str = "parquet") -> None:
    """A result table as Parquet, as JSON lines or as CSV with a header, one file a task."""
    if form not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown form {form!r}")
    writer = result.write.mode("errorifexists")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def console(findings: DataFrame, shown: int = SHOWN) -> str:
    """A line for each of the first findings, the severe ones first, and one that counts the rest."""
    from quarryline.operators.findings import issue_table

    rows = issue_table(findings).limit(shown).collect()
    lines = [f"[{r['Severity']}] {r['Rule']} {r['Column']}: {r['Count']} ({r['Rate']})" for r in rows]
    more = findings.count() - len(rows)
    return "\n".join([*lines, f"and {more} more"] if more else lines)
