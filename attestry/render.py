"""Markdown reports: thin formatters over small result tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def cell(value: object) -> str:
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.4g}"
    if isinstance(value, bool):
        return "yes" if value else "no"
    return ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(columns: list[str], rows: Iterable[Row]) -> str:
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]])


def table(df: DataFrame, order: list | None = None) -> str:
    """A result of a few rows (rules, codes, systems, dimensions) as a table."""
    return markdown_table(df.columns, (df.orderBy(*order) if order else df).collect())


def support_report(support: DataFrame, matrix: DataFrame, contamination: list[str]) -> str:
    warning = f"\n**Gates passed by: {', '.join(contamination)}.**\n" if contamination else ""
    return f"# Rule support\n{warning}\nNumbers are suggestions; a status is changed by hand in the registry.\n\n{table(support.select('rule_id', 'lens', 'status', 'n_support', 'n_periods', 'lift', 'share', 'passed', 'suggestion', 'reasons'), ['rule_id'])}\n\n## Codes by tradition\n\n{table(matrix, ['code'])}\n"


def mining_report(found: DataFrame) -> str:
    out = ["# Candidate rules", ""]
    for r in found.select("scholar_key", "n_inside", "n_outside").distinct().orderBy("scholar_key").collect():
        out += [f"## {r.scholar_key} ({r.n_inside} papers, {r.n_outside} others)", "", table(found.where(F.col("scholar_key") == r.scholar_key).select("place", F.array_join("combo", " + ").alias("combo"), "n", "lift"), ["place"]), ""]
    return "\n".join(out)


def holdout_report(summary: DataFrame, contrasts: DataFrame) -> str:
    return f"# Held-out prediction\n\nMean F1 over families; paired differences with bootstrap intervals.\n\n{table(summary, ['system'])}\n\n{table(contrasts, ['contrast'])}\n"


def blind_report(means: DataFrame, versus: DataFrame, rates: DataFrame, alpha: DataFrame) -> str:
    return f"# Blind rating\n\n{table(means, ['system', 'dim'])}\n\n## Against the baseline\n\n{table(versus, ['system', 'dim'])}\n\n## Fabrications\n\n{table(rates, ['system'])}\n\n## Agreement\n\n{table(alpha, ['dim'])}\n"


def comment_report(found: DataFrame) -> str:
    return f"# Comments\n\n{table(found, ['advisor', F.desc('n'), 'code'])}\n"


def lens_cards(lenses: DataFrame, rules: DataFrame, support: DataFrame | None, statuses: list[str]) -> str:
    """Cards of the lenses with their rules of the given statuses, and what support they have."""
    rows = rules.where(F.col("status").isin(statuses)).join(F.broadcast(lenses.select("lens", "name", "questions")), "lens")
    rows = rows.join(support.select("rule_id", "n_support", "lift"), "rule_id", "left") if support is not None else rows.withColumns({"n_support": F.lit(None), "lift": F.lit(None)})
    out: list[str] = []
    for r in rows.orderBy("lens", "rule_id").collect():
        if f"## {r.lens} {r['name']}" not in out:
            out += [f"## {r.lens} {r['name']}", *[f"- Ask: {q}" for q in r.questions or []]]
        out.append(f"- {r.rule_id}: when {r.trigger}, {r.action}" + ("" if r.n_support is None else f" (support {r.n_support}, lift {cell(r.lift)})"))
    return "\n".join(out) + "\n"


def defect_table(defects: DataFrame) -> str:
    """Codes of the defect codebook by group and severity."""
    return table(defects.select("group", "code", "label", "severity"), ["group", "code"])
