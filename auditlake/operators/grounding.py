"""Grounding: which findings rest on something that was really read.

``tool_calls(session, id, name, args map)``, ``tool_results(session, id, content)``, findings with ``session``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import looks_like_error, max_line, path_variants

#: The tool that reads files, and the arguments that may name one, in order.
READER, PATH_ARGS = "read_file", ["relative_path", "path"]


def pair_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results by (session, id); calls or results alone are dropped."""
    return calls.join(results, ["session", "id"])


def tool_facts(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``session, path, read, failed, max_line``: which files the reading tool was asked for, and up to which line it gave them."""
    path = F.coalesce(*[F.nullif(F.try_element_at("args", F.lit(a)), F.lit("")) for a in PATH_ARGS])
    paired = pair_calls(calls.filter(F.col("name") == READER), results).withColumn("path", path).filter("path is not null").withColumn("bad", looks_like_error("content"))
    return paired.groupBy("session", "path").agg(F.bool_or(~F.col("bad")).alias("read"), F.bool_and("bad").alias("failed"), F.max(F.when(~F.col("bad"), max_line("content"))).alias("max_line"))


def ground(findings: DataFrame, facts: DataFrame, drop: bool = True, apply_to_static: bool = True) -> DataFrame:
    """Adds ``verdict`` (keep, downgrade, drop) and ``reason``; downgraded findings are lowered already.

    A file never read, by its path or a variant of it (the longest one decides): drop. A line beyond the last one read: downgrade. No evidence:
    drop. With ``drop`` false, what would be dropped is downgraded.
    """
    ids = findings.withColumn("_f", F.xxhash64("session", "file_path"))
    wanted = ids.select("_f", "session", "file_path").distinct()
    known = facts.filter("read").select("session", F.col("path").alias("v"), "max_line")
    first = F.when(F.col("max_line") > 0, F.struct((F.col("v") == F.col("file_path")).alias("same"), F.length("v").alias("n"), "v"))
    matched = wanted.withColumn("v", F.explode(path_variants("file_path"))).join(known, ["session", "v"]).groupBy("_f", "session", "file_path").agg(F.max_by("max_line", first).alias("seen_to"), F.lit(True).alias("was_read"))
    out = ids.join(matched, ["_f", "session", "file_path"], "left").drop("_f")
    missing = F.lit("drop" if drop else "downgrade")
    exempt = F.lit(False) if apply_to_static else F.coalesce(F.col("detected_by") == "static", F.lit(False))
    unread, beyond, bare = F.col("was_read").isNull(), F.coalesce(F.col("line_start") > F.col("seen_to"), F.lit(False)), F.coalesce(F.size("evidence") <= 0, F.lit(True))
    reason = F.when(exempt, None).when(unread, "file was not read").when(beyond, "line beyond what was read").when(bare, "no evidence")
    out = out.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNull(), "keep").when(F.col("reason") == "line beyond what was read", "downgrade").otherwise(missing))
    return downgrade(out, F.col("verdict") == "downgrade").drop("was_read", "seen_to")


def downgrade(findings: DataFrame, where) -> DataFrame:
    """Lower findings: severity to warning at most, confidence to 0.4 at most, not verified, a note put before their evidence."""
    note = F.struct(F.lit("reasoning").alias("kind"), F.concat(F.lit("[ungrounded] "), F.coalesce("reason", F.lit(""))).alias("summary"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("source"))
    marked = F.when(F.size("evidence") > 0, F.array_prepend("evidence", note)).otherwise(F.col("evidence"))
    return findings.withColumns({
        "severity": F.when(where & F.col("severity").isin("critical", "error"), "warning").otherwise(F.col("severity")),
        "confidence": F.when(where, F.least("confidence", F.lit(0.4))).otherwise(F.col("confidence")),
        "verified": F.when(where, False).otherwise(F.col("verified")),
        "evidence": F.when(where, marked).otherwise(F.col("evidence")),
    })
