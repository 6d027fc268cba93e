"""Rule scans over lines, with look-back windows, states, depths and block spans.

``lines(path, line_no, text)``; rule tables ``(rule_id, name, severity, pattern, description, suggestion)`` are plain
data and broadcast. Comment lines (``//`` or ``(*`` after trimming) are passed over.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import literals, scans
from .intervals import around

KEYS = ["rule_id", "name", "severity", "description", "suggestion"]


def is_comment(text: Column | str = "text") -> Column:
    trimmed = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.startswith(trimmed, F.lit("//")) | F.startswith(trimmed, F.lit("(*"))


def rule_table(spark, rules: list[tuple]) -> DataFrame:
    """Rows (rule_id, name, severity, pattern, description, suggestion) as a table."""
    return spark.createDataFrame(rules, "rule_id string, name string, severity string, pattern string, description string, suggestion string")


def _tried(pattern: str) -> Column:
    """Whether ``text`` matches; a pattern that needs a literal is tried where the line holds it."""
    needs, matches = literals.required(pattern, 1), F.regexp_like("text", F.lit(pattern))
    return reduce(or_, [F.contains(F.lower("text"), F.lit(x)) for x in needs]) & matches if needs else matches


def scan_rules(lines: DataFrame, rules: DataFrame | list[tuple], code_only: bool = True) -> DataFrame:
    """A violation per line and rule that matches it.

    A list of rules is compiled into one projection, made for lines that some rule matches. Of a table of rules, which may be thousands, a line is tried against
    those only whose literals stand in it (:mod:`.literals`).
    """
    live = lines.filter(~is_comment()) if code_only else lines
    if isinstance(rules, list):
        if not rules:
            rules = rule_table(lines.sparkSession, [])
        else:
            none = F.lit(None).cast("string")
            tried = [_tried(r[3]) for r in rules]
            hits = [F.when(t, F.struct(*[(none if v is None else F.lit(v)).alias(k) for k, v in zip(KEYS, (r[0], r[1], r[2], r[4], r[5]), strict=True)])) for r, t in zip(rules, tried, strict=True)]
            return live.filter(reduce(or_, tried)).select("path", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("v"), "text").select("path", "line_no", "text", "v.*")
    met = literals.candidates(live.select("path", "line_no", "text"), rules.select("pattern", *KEYS))
    return met.filter(F.regexp_like("text", F.col("pattern"))).select("path", "line_no", "text", *KEYS)


def dedup_violations(violations: DataFrame) -> DataFrame:
    return violations.dropDuplicates(["path", "rule_id", "line_no", "description"])


def with_context(lines: DataFrame, before: int, after: int = 0, piece: int = scans.PIECE, of: Column | None = None) -> DataFrame:
    """Adds ``context``: the lines around a line, joined by line ends; with ``of`` to the lines where it holds, which alone come out."""
    return scans.lines_around(lines, ["path"], "line_no", "text", before, after, "context", piece, of).withColumn("context", F.array_join("context", "\n"))


def guarded_hits(lines: DataFrame, hit: Column, guard: Column | str, before: int, after: int = 0, piece: int = scans.PIECE) -> DataFrame:
    """Code lines where ``hit`` holds and no guard pattern stands in the lines around; ``guard`` may be a column."""
    guard = F.lit(guard) if isinstance(guard, str) else guard
    return with_context(lines, before, after, piece, ~is_comment() & hit).filter(~F.regexp_like("context", guard))


def in_block(lines: DataFrame, start: str, end: str, piece: int = scans.PIECE) -> DataFrame:
    """Adds ``inside``: whether the last line so far that matched start or end matched start."""
    mark = F.when(F.regexp_like("text", F.lit(end)), 0).when(F.regexp_like("text", F.lit(start)), 1)
    return scans.last_mark(lines, ["path"], "line_no", mark, "inside", piece=piece).withColumn("inside", F.coalesce("inside", F.lit(0)) == 1)


def nesting_depth(lines: DataFrame, opens: str, closes: str, piece: int = scans.PIECE) -> DataFrame:
    """Adds ``depth`` after each line, held at 0 from below: the running sum less its least value so far, if under 0."""
    step = F.when(F.regexp_like("text", F.lit(opens)), 1).when(F.regexp_like("text", F.lit(closes)), -1).otherwise(0)
    summed = scans.running(lines, ["path"], "line_no", F.when(is_comment(), 0).otherwise(step), "_s", "_low", piece)
    return summed.withColumn("depth", F.col("_s") - F.least(F.lit(0), "_low")).drop("_s", "_low")


def close_rewrites(assignments: DataFrame, gap: int = 3, piece: int = scans.PIECE) -> DataFrame:
    """Assignments (path, var, line_no) whose next to the same variable is under ``gap`` lines away."""
    return scans.next_within(assignments, ["path", "var"], "line_no", gap, "next_line", piece).filter(F.col("next_line") - F.col("line_no") < gap)


def changed_blocks(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """ranges(path, start_line, end_line) with ``name, block_type, line_start, line_end`` of the block that a range starts in.

    Blocks are those of :func:`st_blocks`, lines count as there; of several the first; a range outside any has nulls.
    """
    b = blocks.select("path", F.struct("line_start", "line_end", "name", "block_type").alias("_b"), F.col("line_start").alias("_from"), F.col("line_end").alias("_to"))
    asked = ranges.select("path", "start_line", "end_line").distinct()
    hit = around(asked, b, ["path"], "start_line", "_from", "_to").groupBy("path", "start_line", "end_line").agg(F.min("_b").alias("_b"))
    return asked.join(hit, ["path", "start_line", "end_line"], "left").select("path", "start_line", "end_line", "_b.name", "_b.block_type", "_b.line_start", "_b.line_end")


#: How a block starts.
BLOCK_START = r"(?i)^\s*(FUNCTION_BLOCK|FUNCTION|PROGRAM)\s+(\w+)(?:\s*:\s*(\w+))?"


def st_blocks(lines: DataFrame) -> DataFrame:
    """``path, name, block_type, return_type, line_start, line_end`` (from 0): up to its END_, the next start, or the last line."""
    kind = F.upper(F.regexp_extract("text", BLOCK_START, 1))
    close = F.upper(F.regexp_extract("text", r"(?i)^\s*END_(FUNCTION_BLOCK|FUNCTION|PROGRAM)", 1))
    marked = lines.select("path", (F.col("line_no") - 1).alias("i"), "text", F.nullif(kind, F.lit("")).alias("kind"), F.nullif(close, F.lit("")).alias("close"))
    marked = marked.filter("kind is not null or close is not null").join(marked.groupBy("path").agg(F.max("i").alias("final")), "path")
    blocks = marked.withColumn("block", F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("i")))
    spans = _spans(blocks)
    nxt = F.lead("line_start").over(Window.partitionBy("path").orderBy("line_start"))
    return spans.withColumn("line_end", F.coalesce("closed", nxt - 1, "final")).select("path", F.regexp_extract("text", BLOCK_START, 2).alias("name"), F.col("kind").alias("block_type"), F.nullif(F.regexp_extract("text", BLOCK_START, 3), F.lit("")).alias("return_type"), "line_start", "line_end")


def _spans(blocks: DataFrame) -> DataFrame:
    own = blocks.withColumn("opened", F.first("kind").over(Window.partitionBy("path", "block").orderBy("i"))).filter("block > 0")
    shut = F.min(F.when(F.col("kind").isNull() & (F.col("close") == F.col("opened")), F.col("i")))
    return own.groupBy("path", "block").agg(F.max("opened").alias("kind"), F.min_by("text", "i").alias("text"), F.min("i").alias("line_start"), shut.alias("closed"), F.max("final").alias("final"))


def st_vars(files: DataFrame) -> DataFrame:
    """``path, scope, name, datatype, initial_value, comment`` of every declaration in a VAR block; comments are not read."""
    blocks = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)(VAR(?:_INPUT|_OUTPUT|_IN_OUT|_GLOBAL|_TEMP)?\s*(?::\s*.+?)?\s*\n.*?END_VAR)"), F.lit(1))).alias("block"))
    blocks = blocks.select("path", F.upper(F.regexp_extract("block", r"(?i)^(VAR\w*)", 1)).alias("scope"), F.regexp_extract("block", r"(?is)^[^\n]*\n(.*?)END_VAR", 1).alias("body"))
    decl = r"(?i)(\w+)\s*:\s*(\w+(?:\s*\([^)]*\))?)(?:\s*:=\s*(.+?))?;"
    each = blocks.select("path", "scope", F.explode(F.regexp_extract_all("body", F.lit(decl), F.lit(0))).alias("d"))
    return each.select("path", "scope", F.regexp_extract("d", decl, 1).alias("name"), F.trim(F.regexp_extract("d", decl, 2)).alias("datatype"), F.nullif(F.trim(F.regexp_extract("d", decl, 3)), F.lit("")).alias("initial_value"), F.lit(None).cast("string").alias("comment"))
