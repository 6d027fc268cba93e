"""Queries of functions that the other modules do not reach: texts, patches of every kind, importers, call sites, spans, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import clones, history, patches, rules, symbols
from ..shared import materialize, ship
from . import code


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, previews and failed results of all documents, behind openings that differ."""
    opening = F.element_at(F.array(*map(F.lit, ["", "Error: ", "  error: ", "Tool error: ", "an Error: ", "said: File Not Found "])), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(opening, "text").alias("t"))
    return docs.select("doc_id", S.title_cut("t").alias("title"), F.sha2(S.preview("t"), 256).alias("preview"), S.looks_like_error("t").alias("failed"))


def stripped_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with fabricated markup behind them."""
    turns = _table(spark, sf_dir, "conversations")
    made = F.concat("text", F.lit(" <Tool_Call>{\n"), F.col("turn").cast("string"), F.lit("}</tool_call> and ```tool_call x\n``` end"))
    return turns.select("conv_id", "turn", F.sha2(S.strip_markup(made), 256).alias("sha256"))


def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of urls against one of four globs."""
    globs = F.array(*map(F.lit, ["*.html", "/?n/*", "/*[1]*", "*"]))
    rows = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("p"), F.element_at(globs, (F.col("page_id") % 4 + 1).cast("int")).alias("glob"))
    return rows.select("page_id", S.glob_match("p", F.col("glob")).alias("hit"))


def planned_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is decided on a patch for each document, and which need no question."""
    planned = patches.plan_fixes(_table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 101 / 100).alias("confidence")))
    sure = patches.auto_approvable(planned).select("doc_id", F.lit(True).alias("auto"))
    return planned.join(sure, "doc_id", "left").select("doc_id", "decision", F.coalesce("auto", F.lit(False)).alias("auto"))


def patch_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file with a patch set of one of six kinds, some by other names of the file."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), (F.col("doc_id") % 6).cast("int").alias("k"))
    pick = lambda *values: F.element_at(F.array(*values), F.col("k") + 1)
    none, path = F.lit(None).cast("string"), F.col("path")
    at = lambda head: F.concat(F.lit(head), path)
    line = F.when(F.col("k") < 2, 1)
    ops = docs.select(
        path.alias("patchset_id"), F.lit(0).alias("op_idx"), pick(*map(F.lit, ["edit", "delete_lines", "delete_file", "create_file", "rename", "rename"])).alias("op_type"),
        pick(at("./"), at("x/../"), path, at("new/"), path, path).alias("file_path"), line.alias("line_start"), line.alias("line_end"), F.when(F.col("k") < 2, F.substring_index("content", "\n", 1)).alias("old_content"),
        pick(F.lit("NEW"), none, none, F.lit("made"), none, none).alias("new_content"), pick(none, none, none, none, at("moved/./"), at("../")).alias("new_path"), F.lit("x").alias("reason"),
    )
    return patches.apply_patches(docs.select("path", "content"), ops).select("path", F.sha2("content", 256).alias("sha256"))


def redone_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session undone as a session, and that one undone: the files after the first."""
    from .catalog import _doc_patches

    files, ops = _doc_patches(spark, sf_dir)
    kept, after = patches.snapshot(files, ops, "s1"), materialize(patches.apply_patches(files, ops), "patched")  # read three times below
    undone, kept, _ = patches.undo_session(after, kept, "s1", "u1")
    again, _, _ = patches.undo_session(undone, kept, "u1", "u2")
    return again.select("path", F.sha2("content", 256).alias("sha256"))


def importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who imports each module."""
    return symbols.importers(code.resolve_imports(spark, sf_dir).withColumn("repo", F.lit("r"))).select("resolved", F.array_join("importers", ",").alias("importers"))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty calls of one function."""
    calls = code.resolve_calls(spark, sf_dir).withColumn("repo", F.lit("r"))
    return symbols.call_sites_of(calls, "f7").select("path", "line")


def function_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost of an order's items, as functions, around lines four below their starts."""
    li = _table(spark, sf_dir, "lineitem")
    fps = li.select(F.col("l_orderkey").alias("path"), F.concat("l_partkey", F.lit("-"), "l_suppkey").alias("id"), F.col("l_linenumber").alias("line_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("line_end"))
    return clones.function_at(fps, li.select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") + 4).alias("line")).distinct())


def changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of an order's items, as blocks, that a range starts in."""
    li = _table(spark, sf_dir, "lineitem")
    blocks = li.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("block_type"), (F.col("l_linenumber") * 10).alias("line_start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("line_end"))
    ranges = li.select(F.col("l_orderkey").alias("path"), (F.col("l_suppkey") % 90).cast("int").alias("start_line"), (F.col("l_suppkey") % 90 + 5).cast("int").alias("end_line"))
    return rules.changed_blocks(ranges, blocks).select("path", "start_line", "name", "line_start", "line_end")


def past_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events but the newest five."""
    return history.dropped_by_retention(_table(spark, sf_dir, "events"), 5, "user_id", "ts", "event_id").select("user_id", "event_id")


_OPENED = "(SELECT doc_id, ['', 'Error: ', '  error: ', 'Tool error: ', 'an Error: ', 'said: File Not Found '][doc_id % 6 + 1] || text AS t FROM documents)"
_REST = "CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"
ORACLE_SQL = {
    "text_functions": f"""SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS title, sha256(CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || '...' ELSE t END) AS preview,
      contains(lower(t), 'file not found') OR starts_with(ltrim(t), 'Error:') OR starts_with(ltrim(t), 'error:') OR starts_with(ltrim(t), 'Tool error:') AS failed FROM {_OPENED}""",
    "stripped_markup": "SELECT conv_id, turn, sha256(trim(text || ' [removed: fabricated tool-call markup] and [removed: fabricated tool-call markup] end')) AS sha256 FROM conversations",
    "glob_matches": "WITH u AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages) SELECT page_id, CASE page_id % 4 WHEN 0 THEN p LIKE '%.html' WHEN 1 THEN p LIKE '/_n/%' WHEN 2 THEN p LIKE '/%[1]%' ELSE true END AS hit FROM u",
    "planned_fixes": "SELECT doc_id, CASE WHEN doc_id % 101 >= 95 THEN 'apply' ELSE 'needs_review' END AS decision, doc_id % 101 >= 95 AS auto FROM documents",
    "patch_kinds": f"""WITH d AS (SELECT doc_id::VARCHAR AS id, text, doc_id % 6 AS k FROM documents)
    SELECT CASE WHEN k = 4 THEN 'moved/' || id ELSE id END AS path, sha256(CASE WHEN k > 1 OR text = '' THEN text WHEN k = 1 THEN {_REST} WHEN contains(text, chr(10)) AND {_REST} <> '' THEN 'NEW' || chr(10) || {_REST} ELSE 'NEW' END) AS sha256 FROM d WHERE k <> 2
    UNION ALL SELECT 'new/' || id, sha256('made') FROM d WHERE k = 3""",
    "redone_patches": f"SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN n_chars % 2 = 0 THEN {_REST} ELSE text END) AS sha256 FROM documents",
    "importers": f"SELECT resolved, string_agg(DISTINCT path, ',' ORDER BY path) AS importers FROM ({code.IMPORTS_SQL}) WHERE resolved IS NOT NULL GROUP BY resolved",
    "call_sites": f"SELECT path, line FROM ({code.CALLS_SQL}) WHERE callee_name = 'f7' ORDER BY path, line LIMIT 30",
    "function_at": """WITH f AS (SELECT l_orderkey AS path, l_partkey || '-' || l_suppkey AS id, l_linenumber AS a, l_linenumber + l_quantity::INT AS b FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS path, l_linenumber + 4 AS line FROM lineitem)
    SELECT p.path, line, arg_min(id, struct_pack(x := b - a, y := a, z := id)) AS id FROM p JOIN f ON f.path = p.path AND line BETWEEN a AND b GROUP BY ALL""",
    "changed_blocks": """WITH b AS (SELECT l_orderkey AS path, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity::INT AS z, l_partkey::VARCHAR AS name, l_returnflag AS kind FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS path, (l_suppkey % 90)::INT AS start_line FROM lineitem),
    h AS (SELECT r.path, start_line, min(struct_pack(a := a, z := z, name := name, kind := kind)) AS f FROM r LEFT JOIN b ON b.path = r.path AND start_line BETWEEN a AND z GROUP BY ALL)
    SELECT path, start_line, f.name AS name, f.a AS line_start, f.z AS line_end FROM h""",
    "past_retention": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k > 5",
}
QUERIES = {f.__name__: f for f in (text_functions, stripped_markup, glob_matches, planned_fixes, patch_kinds, redone_patches, importers, call_sites, function_at, changed_blocks, past_retention)}
