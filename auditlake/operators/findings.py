"""The findings table: normal form, roll-ups, gate, ranking and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEVERITIES = ["info", "warning", "error", "critical"]
CATEGORIES = ["security", "potential_bug", "performance", "readability", "redundancy", "architecture", "code_style", "convention"]
EVIDENCE = "array<struct<kind:string,summary:string,detail:string,source:string>>"
SCHEMA = f"file_path string, line_start int, line_end int, severity string, category string, title string, hypothesis string, evidence {EVIDENCE}, counter_considered string, confidence double, verified boolean, suggestion string, detected_by string"
#: Category order by review mode.
PRIORITIES = {
    "review": ["security", "potential_bug", "architecture", "convention", "code_style", "performance", "redundancy", "readability"],
    "audit": ["security", "potential_bug", "performance", "architecture", "redundancy", "code_style", "convention", "readability"],
    "dedup": ["redundancy", "potential_bug", "architecture", "performance", "readability", "convention", "security", "code_style"],
}


def sev_rank(severity: Column | str = "severity") -> Column:
    """0 for info up to 3 for critical; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity) if isinstance(severity, str) else severity), F.lit(0)) - 1


def evidence(kind: str, summary: Column, detail: Column | None = None, source: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), F.substring(summary, 1, 300).alias("summary"), (none if detail is None else detail).alias("detail"), (none if source is None else source).alias("source"))


def clean(findings: DataFrame) -> DataFrame:
    """Unknown severities become warning, unknown categories potential_bug, confidence is held within 0 and 1."""
    return findings.withColumns({
        "severity": F.when(F.col("severity").isin(SEVERITIES), F.col("severity")).otherwise("warning"),
        "category": F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("potential_bug"),
        "confidence": F.least(F.greatest(F.coalesce(F.col("confidence"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)),
    })


def combine(*tables: DataFrame) -> DataFrame:
    """Findings of analyzers, rules and people, one under the other."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES], F.count("*").alias("n_total"))


def rollup_findings(findings: DataFrame, dims: list[str]) -> DataFrame:
    """Counts for all combinations of the dimensions; ``level`` tells which are summed over (grouping_id)."""
    return findings.cube(*dims).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.max(sev_rank()).alias("worst"))


def systemic(findings: DataFrame, rule: str = "title", min_files: int = 3) -> DataFrame:
    """Rules that fire in many files."""
    return findings.groupBy(rule).agg(F.countDistinct("file_path").alias("n_files"), F.count("*").alias("n")).filter(F.col("n_files") >= min_files)


def gate(findings: DataFrame, *by: str) -> DataFrame:
    """``exit_code`` 2 where a critical finding stands, else 0; without ``by`` one row, also for no findings."""
    bad = F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False))
    return findings.groupBy(*by).agg(F.when(bad, 2).otherwise(0).alias("exit_code"))


def rank_findings(findings: DataFrame, mode: str = "audit") -> DataFrame:
    """By the mode's category order, then severity and confidence, then place."""
    order = F.array_position(F.array(*map(F.lit, PRIORITIES[mode])), F.col("category"))
    return findings.orderBy(F.when(order == 0, 99).otherwise(order), sev_rank().desc_nulls_last(), F.col("confidence").desc(), "file_path", "line_start", "title")


def head_with_rest(findings: DataFrame, n: int = 50, order: tuple[str, ...] = ("file_path", "line_start", "title")) -> DataFrame:
    """The first n rows with how many more there are, in ``n_more``."""
    return findings.orderBy(*order).limit(n).crossJoin(F.broadcast(findings.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n_more"))))


def scope(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings in the named files."""
    return findings.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def report(findings: DataFrame, by: str = "run_id") -> DataFrame:
    """One nested row per run: counts and its findings in order."""
    listed = F.array_sort(F.collect_list(F.struct((-sev_rank()).alias("order"), "file_path", "line_start", "title", "severity", "category", "confidence")))
    return findings.groupBy(by).agg(F.count("*").alias("n_total"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES], F.transform(listed, lambda x: x.dropFields("order")).alias("findings"))


def write_report_json(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def render_markdown(reports: DataFrame, by: str = "run_id") -> DataFrame:
    """``run_id, markdown``: counts, then the findings by severity, worst first."""
    title = F.concat(F.lit("# Review "), F.col(by).cast("string"), F.lit("\n\n"), F.col("n_total").cast("string"), F.lit(" findings\n"))
    parts = [title]
    for s in reversed(SEVERITIES):
        own = F.filter("findings", (lambda level: lambda x: x["severity"] == level)(s))
        lines = F.transform(own, lambda x: F.concat(F.lit("- **"), x["title"], F.lit("** `"), x["file_path"], F.lit(":"), F.coalesce(x["line_start"].cast("string"), F.lit("?")), F.lit("` ("), x["category"], F.format_string(", %.2f)", x["confidence"])))
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit(f"\n## {s.capitalize()}\n\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""))
    return reports.select(by, F.concat(*parts).alias("markdown"))
