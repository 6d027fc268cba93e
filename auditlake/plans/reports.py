"""Queries of the analyzers: events become reports in each tool's own format, which are read back and brought into findings.

Each tool has a list of cases: what its report says, and which severity, category and confidence should come of it.
Events take them in turn; a report holds a thousand of them. SQL knows the expected values only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import scratch_path, ship
from ..sources import analyzers

#: By tool, (what the report says), severity, category, confidence; None stands for an issue that is left out.
CASES = {
    "oxlint": [(("eslint(no-eval)", "warning"), "critical", "security", 0.95), (("no-debugger", "error"), "error", "code_style", 0.95), (("typescript-eslint(no-unused-vars)", "warning"), "warning", "redundancy", 0.95), (("react(jsx-no-target-blank)", "warning"), "warning", "security", 0.95), (("oxc(no-perf-loop)", "error"), "error", "performance", 0.95), (("eslint(use-isnan)", "warning"), "error", "potential_bug", 0.95)],
    "bandit": [(("B301", "HIGH", "HIGH"), "critical", "security", 0.85), (("B602", "MEDIUM", "LOW"), "warning", "security", 0.65), (("B101", "LOW", "LOW"), "info", "convention", 0.65), (("B108", "LOW", "HIGH"), "warning", "security", 0.85), (("B105", "HIGH", "LOW"), "error", "security", 0.65)],
    "clippy": [(("clippy::needless_borrow", "warning"), "warning", "potential_bug", 0.95), (("clippy::unwrap_used", "error"), "error", "security", 0.95), (("unused_variables", "note"), "info", "redundancy", 0.95), (("clippy::perf", "warning"), "error", "performance", 0.95), (("clippy::too_many_lines", "help"), "info", "readability", 0.95), (("clippy::cast_lossless", "other"), "warning", "code_style", 0.95)],
    "cppcheck": [(("nullPointer", "error", "476"), "critical", "security", 0.9), (("unusedVariable", "style", None), "info", "code_style", 0.7), (("arrayIndex", "warning", None), "warning", "potential_bug", 0.9), (("passedByValue", "performance", "398"), "info", "performance", 0.7), (("syntaxError", "error", None), "error", "potential_bug", 0.9), (("missingIncludeSystem", "information", None), None, None, None)],
    "spotbugs": [(("SECURITY", "1", "20"), "critical", "security", 0.85), (("STYLE", "3", "18"), "warning", "code_style", 0.7), (("PERFORMANCE", "2", "20"), "error", "performance", 0.85), (("CORRECTNESS", "4", "20"), "info", "potential_bug", 0.7), (("BAD_PRACTICE", "5", "9"), "error", "code_style", 0.7)],
    "golangci": [(("gosec", ""), "error", "security", 0.9), (("errcheck", ""), "warning", "potential_bug", 0.9), (("prealloc", ""), "info", "performance", 0.9), (("unused", "error"), "error", "redundancy", 0.9), (("lll", ""), "info", "code_style", 0.9)],
    "shellcheck": [((2086, "style"), "info", "security", 0.9), ((1091, "error"), "error", "potential_bug", 0.9), ((2034, "info"), "info", "potential_bug", 0.9), ((2006, "style"), "info", "code_style", 0.9), ((2155, "warning"), "warning", "security", 0.9)],
    "luacheck": [(("W311",), "warning", "potential_bug", 0.8), (("E011",), "error", "potential_bug", 0.9), (("W611",), "info", "code_style", 0.8), (("W111",), "info", "convention", 0.8), (("W542",), "warning", "potential_bug", 0.8)],
    "sqlfluff": [(("PRS",), "error", "potential_bug", 0.95), (("L010",), "warning", "code_style", 0.8), (("L045",), "warning", "convention", 0.8), (("RF01",), "info", "convention", 0.8)],
    "rubocop": [(("Security/Eval", "warning"), "warning", "security", 0.75), (("Performance/Count", "convention"), "info", "performance", 0.75), (("Lint/Void", "error"), "error", "potential_bug", 0.9), (("Style/Not", "refactor"), "info", "code_style", 0.75), (("Metrics/AbcSize", "refactor"), "info", "convention", 0.75), (("Lint/Syntax", "fatal"), "critical", "potential_bug", 0.9)],
    "phpstan": [(("Possible SQL injection:",), "warning", "security", 0.85), (("Call to deprecated method",), "warning", "convention", 0.85), (("Undefined variable",), "warning", "potential_bug", 0.85)],
    "detekt": [(("complexity.LongMethod", "fatal"), "critical", "architecture", 0.85), (("style.MagicNumber", "warning"), "warning", "code_style", 0.85), (("performance.SpreadOperator", "info"), "info", "performance", 0.85), (("exceptions.TooGeneric", "error"), "error", "potential_bug", 0.85), (("rules.Other", "unknown"), "warning", "convention", 0.85)],
    "verilator": [(("Warning", "WIDTH"), "warning", "potential_bug", 0.9), (("Error", None), "error", "potential_bug", 0.9), (("Warning", "UNUSED"), "warning", "code_style", 0.9), (("Info", "FOO"), "info", "convention", 0.9)],
}
#: Whose reports tell where an issue ends.
WITH_END = {"bandit", "spotbugs", "shellcheck", "rubocop", "detekt", "clippy"}


def _rows(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """``report, i, path, line, last, message`` of every event, and what its case says as ``c0, c1, ...``."""
    events = ship(spark).read.parquet(f"{sf_dir}/events.parquet")
    cases = CASES[tool]
    at = (F.col("event_id") % len(cases)).cast("int")
    said = [F.array(*[F.lit(c[0][j]).cast("string") for c in cases])[at].alias(f"c{j}") for j in range(len(cases[0][0]))]
    line = (F.col("event_id") % 500 + 1).cast("int")
    return events.select(F.floor(F.col("event_id") / 1000).alias("report"), F.concat(F.lit("/repo/src/u"), F.col("user_id").cast("string"), F.lit(".x")).alias("path"), line.alias("line"), (line + F.col("event_id") % 3).cast("int").alias("last"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("message"), *said)


def _listed(rows: DataFrame, item: Column, name: str | None) -> DataFrame:
    """One JSON text per report: a list of its issues, under a name where the tool has one."""
    grouped = rows.groupBy("report").agg(F.collect_list(item).alias("x"))  # a thousand at most
    return grouped.select("report", F.to_json(F.struct(F.col("x").alias(name)) if name else F.col("x")).alias("value"))


def _wrapped(rows: DataFrame, item: Column, root: str) -> DataFrame:
    """One XML text per report: its issues within a root element."""
    grouped = rows.groupBy("report").agg(F.array_join(F.collect_list(item), "\n").alias("x"))  # a thousand at most
    return grouped.select("report", F.concat(F.lit(f"<{root}>"), "x", F.lit(f"</{root}>")).alias("value"))


def _report(rows: DataFrame, tool: str) -> DataFrame:
    """``report, value``: the lines of each report."""
    c = F.col
    place = F.struct("line", c("last").alias("last_line"))
    if tool == "oxlint":
        return _listed(rows, F.struct("message", c("c0").alias("code"), c("c1").alias("severity"), c("path").alias("filename"), F.array(F.struct(F.struct("line").alias("span"))).alias("labels")), "diagnostics")
    if tool == "bandit":
        return _listed(rows, F.struct(c("path").alias("filename"), c("line").alias("line_number"), F.sequence("line", "last").alias("line_range"), c("c0").alias("test_id"), c("c1").alias("issue_severity"), c("c2").alias("issue_confidence"), c("message").alias("issue_text")), "results")
    if tool == "golangci":
        return _listed(rows, F.struct(c("c0").alias("FromLinter"), c("message").alias("Text"), c("c1").alias("Severity"), F.struct(c("path").alias("Filename"), c("line").alias("Line")).alias("Pos")), "Issues")
    if tool == "shellcheck":
        return _listed(rows, F.struct(c("path").alias("file"), "line", c("last").alias("endLine"), c("c1").alias("level"), c("c0").cast("int").alias("code"), "message"), None)
    if tool == "sqlfluff":
        return _listed(rows, F.struct(c("path").alias("filepath"), F.array(F.struct(c("line").alias("line_no"), c("c0").alias("code"), c("message").alias("description"))).alias("violations")), None)
    if tool == "rubocop":
        return _listed(rows, F.struct("path", F.array(F.struct(c("c1").alias("severity"), "message", c("c0").alias("cop_name"), place.alias("location"))).alias("offenses")), "files")
    if tool == "phpstan":
        found = rows.groupBy("report", "path").agg(F.struct(F.collect_list(F.struct(F.concat_ws(" ", "c0", "message").alias("message"), "line")).alias("messages")).alias("m"))
        return found.groupBy("report").agg(F.map_from_entries(F.collect_list(F.struct("path", "m"))).alias("files")).select("report", F.to_json(F.struct("files")).alias("value"))
    if tool == "detekt":
        return _listed(rows, F.struct("path", F.array(F.struct(c("c0").alias("ruleId"), "message", c("c1").alias("severity"), F.struct(c("line").alias("startLine"), c("last").alias("endLine")).alias("location"))).alias("issues")), "files")
    if tool == "clippy":
        span = F.struct(c("path").alias("file_name"), c("line").alias("line_start"), c("last").alias("line_end"), F.lit(True).alias("is_primary"))
        message = F.struct("message", c("c1").alias("level"), F.struct(c("c0").alias("code")).alias("code"), F.array(span).alias("spans"))
        return rows.select("report", F.to_json(F.struct(F.lit("compiler-message").alias("reason"), message.alias("message"))).alias("value"))
    if tool == "cppcheck":
        cwe = F.coalesce(F.concat(F.lit(' cwe="'), "c2", F.lit('"')), F.lit(""))
        return _wrapped(rows, F.concat(F.format_string('<error id="%s" severity="%s" msg="%s"', "c0", "c1", "message"), cwe, F.format_string('><location file="%s" line="%d" column="1"/></error>', "path", "line")), "errors")
    if tool == "spotbugs":
        return _wrapped(rows, F.format_string('<BugInstance type="T" category="%s" priority="%s" rank="%s"><ShortMessage>s</ShortMessage><LongMessage>%s</LongMessage><SourceLine sourcefile="%s" start="%d" end="%d"/></BugInstance>', "c0", "c1", "c2", "message", "path", "line", "last"), "BugCollection")
    if tool == "luacheck":
        return rows.select("report", F.format_string("%s:%d:5-9: (%s) %s", "path", "line", "c0", "message").alias("value"))
    return rows.select("report", F.format_string("%%%s: %s:%d:3: %s", F.concat_ws("-", "c0", "c1"), "path", "line", "message").alias("value"))


def analyzer_query(tool: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_path(spark, f"report-{tool}")
        _report(_rows(spark, sf_dir, tool), tool).write.partitionBy("report").text(folder)
        found = analyzers.normalize(analyzers.read_report(spark, tool, folder), tool, "/repo")
        return found.select("file_path", "line_start", "line_end", "severity", "category", "title", "confidence")

    run.__name__, run.__doc__ = f"findings_{tool}", f"Reports of {tool}, one issue per event, as findings."
    return run


def analyzer_sql(tool: str) -> str:
    cases = CASES[tool]
    values = ", ".join(f"({i}, '{s}', '{c}', {x})" for i, (_, s, c, x) in enumerate(cases) if s)
    line = "(event_id % 500 + 1)::INT"
    last = f"({line} + event_id % 3)::INT"
    end = "NULL::INT" if tool not in WITH_END else f"CASE WHEN event_id % 3 > 0 THEN {last} END" if tool in ("clippy", "bandit") else last
    title = "event_type || ' ' || event_id"
    if tool == "phpstan":
        title = f"{[c[0][0] for c in cases]}[event_id % {len(cases)} + 1] || ' ' || {title}"
    return f"""WITH expected(k, severity, category, confidence) AS (VALUES {values})
    SELECT 'src/u' || user_id || '.x' AS file_path, {line} AS line_start, {end} AS line_end, severity, category, {title} AS title, confidence::DOUBLE AS confidence
    FROM events JOIN expected ON event_id % {len(cases)} = k"""


QUERIES = {f"findings_{tool}": analyzer_query(tool) for tool in CASES}
ORACLE_SQL = {f"findings_{tool}": analyzer_sql(tool) for tool in CASES}
