"""Patch sets over versioned file tables: check, apply, snapshot, undo.

``files(path, content)``; ``patch_ops(patchset_id, op_idx, op_type, file_path, line_start, line_end, old_content,
new_content, new_path, reason)`` with an op_type of OP_TYPES. A set applies as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import escapes, lenient, normal_path, split_lines
from ..shared import materialize
from .history import retain_newest
from .intervals import overlapping

#: What an op can do.
OP_TYPES = ["edit", "delete_lines", "delete_file", "create_file", "rename"]
MAX_SNAPSHOT = 1 << 20


def resolved(ops: DataFrame) -> DataFrame:
    """The ops with both paths folded (``./a`` and ``b/../a`` are ``a``); paths that escape the root stay as they are."""
    fold = lambda c: F.when(escapes(c), F.col(c)).otherwise(normal_path(c))
    return ops.withColumns({"file_path": fold("file_path"), "new_path": fold("new_path")})


def _reasons(ops: DataFrame, files: DataFrame) -> DataFrame:
    """The resolved ops with ``why``: what hinders each by itself, against the files as they are."""
    source = files.select(F.col("path").alias("file_path"), F.col("content").alias("_c"))
    target = files.select(F.col("path").alias("new_path"), F.lit(True).alias("_taken"))
    rows = resolved(ops).join(source, "file_path", "left").join(target, "new_path", "left").withColumn("_lines", split_lines("_c"))
    lines = F.col("_lines")
    region = F.array_join(F.slice(lines, F.greatest("line_start", F.lit(1)), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))), "")
    kind, there = F.col("op_type"), F.col("_c").isNotNull()
    edits = kind.isin("edit", "delete_lines")
    why = (
        F.when(escapes("file_path"), "path escapes the root")
        .when((kind == "create_file") & there, "file exists already")
        .when((kind == "create_file") & F.col("new_content").isNull(), "create_file needs new_content")
        .when(kind.isin("delete_file", "rename", "edit", "delete_lines") & ~there, "file does not exist")
        .when((kind == "rename") & F.col("new_path").isNull(), "rename needs new_path")
        .when((kind == "rename") & escapes("new_path"), "new_path escapes the root")
        .when((kind == "rename") & F.col("_taken"), "target exists already")
        .when(edits & (F.col("line_start").isNull() | F.col("line_end").isNull()), "needs line_start and line_end")
        .when(edits & ((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start"))), "invalid line range")
        .when(edits & F.col("old_content").isNull(), "needs old_content")
        .when(edits & (F.col("line_end") > F.size(lines)), "line_end beyond the file")
        .when(edits & (lenient(region) != lenient("old_content")), "old_content does not match")
        .when((kind == "edit") & F.col("new_content").isNull(), "edit needs new_content")
        .when(~F.coalesce(kind.isin(OP_TYPES), F.lit(False)), "unknown op_type")
    )
    return rows.withColumn("why", why).select(*ops.columns, "why")


def _clashes(ops: DataFrame) -> DataFrame:
    """``patchset_id, op_idx``: edits that overlap an earlier one of their set, and ops on what a set of smaller id works on.

    Edits work on their lines, all other ops on whole files. Of the edits of one range only the first of the least set
    can come before others, so that many sets on the same lines are no many pairs.
    """
    edits = F.col("op_type").isin("edit", "delete_lines")
    claims = ops.select("patchset_id", "op_idx", edits.alias("edits"), F.col("line_start").alias("low"), F.col("line_end").alias("high"), F.explode(F.array_distinct(F.array_compact(F.array("file_path", F.when(F.col("op_type") == "rename", F.col("new_path")))))).alias("path"))
    lines = claims.filter("edits")
    first = lines.groupBy("path", F.col("low").alias("_low"), F.col("high").alias("_high")).agg(F.min(F.struct("patchset_id", "op_idx")).alias("_first"))
    meet = overlapping(lines, first, ["path"])
    earlier = (F.col("_first.patchset_id") < F.col("patchset_id")) | ((F.col("_first.patchset_id") == F.col("patchset_id")) & (F.col("_first.op_idx") < F.col("op_idx")))
    wholes = claims.groupBy("path").agg(F.min("patchset_id").alias("_any"), F.min(F.when(~F.col("edits"), F.col("patchset_id"))).alias("_whole"))
    beaten = claims.join(wholes, "path").filter(F.col("patchset_id") > F.when(F.col("edits"), F.col("_whole")).otherwise(F.col("_any")))
    return meet.filter(earlier).select("patchset_id", "op_idx").unionByName(beaten.select("patchset_id", "op_idx")).distinct()


def _checked(ops: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The resolved ops with their reasons, stored once, and :func:`can_apply`."""
    rows = materialize(_reasons(ops, files), "patch-ops")
    first = F.min(F.when(F.col("why").isNotNull(), F.struct("op_idx", "why")))
    own = rows.groupBy("patchset_id").agg(first.alias("f"))
    fine = rows.join(own.filter("f is null"), "patchset_id", "left_semi")
    late = _clashes(fine).groupBy("patchset_id").agg(F.lit("overlaps an earlier op").alias("late"))
    out = own.join(late, "patchset_id", "left").withColumn("reason", F.coalesce("f.why", "late"))
    return rows, out.select("patchset_id", F.col("reason").isNull().alias("ok"), "reason")


def can_apply(ops: DataFrame, files: DataFrame) -> DataFrame:
    """``patchset_id, ok, reason``: the first failing op's reason; a set is good if no op fails.

    Of the sets that are good by themselves, one that works on the same lines or files as one of smaller id is refused,
    whether or not that one is refused for the same reason: the outcome does not hang on chains of sets.
    """
    return _checked(ops, files)[1]


def applicable(ops: DataFrame, files: DataFrame) -> DataFrame:
    """Ops of the sets that can apply as a whole, with their paths resolved."""
    rows, verdict = _checked(ops, files)
    return rows.drop("why").join(verdict.filter("ok"), "patchset_id", "left_semi")


def apply_patches(files: DataFrame, ops: DataFrame, sequential: bool = False) -> DataFrame:
    """The files after all sets that can apply: edits from the last line up (or in op order), creates, deletes, renames."""
    good = materialize(applicable(ops, files), "patches-good")  # read four times below
    key = F.struct((F.lit(1) if sequential else -F.col("line_start")).alias("k"), "patchset_id", "op_idx", "line_start", "line_end", F.when(F.col("op_type") == "edit", F.col("new_content")).otherwise("").alias("new"))
    edits = good.filter(F.col("op_type").isin("edit", "delete_lines")).groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(key)).alias("_ops"))

    def step(a, o):
        after = F.slice(a, o["line_end"] + 1, F.greatest(F.size(a), F.lit(1)))
        # What is put in ends with a line end if lines follow it.
        open_end = (o["new"] != "") & (F.size(after) > 0) & ~F.regexp_like(o["new"], F.lit("\n$"))
        return F.concat(F.slice(a, F.lit(1), F.greatest(o["line_start"] - 1, F.lit(0))), split_lines(F.concat(o["new"], F.when(open_end, "\n").otherwise(""))), after)

    edited = files.join(edits, "path", "left").withColumn("content", F.when(F.col("_ops").isNull(), F.col("content")).otherwise(F.array_join(F.aggregate("_ops", split_lines("content"), step), ""))).drop("_ops")
    gone = good.filter("op_type = 'delete_file'").select(F.col("file_path").alias("path")).distinct()
    moved = good.filter("op_type = 'rename'").groupBy(F.col("file_path").alias("path")).agg(F.min_by("new_path", F.struct("patchset_id", "op_idx")).alias("_to"))
    out = edited.join(gone, "path", "left_anti").join(moved, "path", "left").withColumn("path", F.coalesce("_to", "path")).select(files.columns)
    made = good.filter("op_type = 'create_file'").groupBy(F.col("file_path").alias("path")).agg(F.min_by("new_content", F.struct("patchset_id", "op_idx")).alias("content"))
    return out.unionByName(made, allowMissingColumns=True)


def affected_files(ops: DataFrame) -> DataFrame:
    return ops.groupBy("patchset_id").agg(F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_list(F.array("file_path", "new_path")))))).alias("files"))


def snapshot(files: DataFrame, ops: DataFrame, session_id: str, limit: int = MAX_SNAPSHOT, earlier: DataFrame | None = None) -> DataFrame:
    """``session_id, relpath, existed, oversized, content`` of the files that ops touch, before they do."""
    paths = resolved(ops).select(F.explode(F.array_compact(F.array("file_path", "new_path"))).alias("relpath")).distinct()
    rows = paths.join(files.select(F.col("path").alias("relpath"), "content"), "relpath", "left")
    over = F.coalesce(F.octet_length("content") > limit, F.lit(False))
    out = rows.select(F.lit(session_id).alias("session_id"), "relpath", F.col("content").isNotNull().alias("existed"), over.alias("oversized"), F.when(~over, F.col("content")).alias("content"))
    return out if earlier is None else earlier.unionByName(out.join(earlier.select("session_id", "relpath"), ["session_id", "relpath"], "left_anti"))


def undo(files: DataFrame, snapshots: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """(files as before the session, warnings ``relpath, warning`` for what was too large to store)."""
    own = snapshots.filter(F.col("session_id") == session_id)
    back = own.filter("existed and not oversized").select(F.col("relpath").alias("path"), "content")
    touched = own.filter("not oversized").select(F.col("relpath").alias("path"))
    kept = files.join(touched, "path", "left_anti")
    return kept.unionByName(back, allowMissingColumns=True), own.filter("oversized").select("relpath", F.lit("too large to have been stored").alias("warning"))


def undo_session(files: DataFrame, snapshots: DataFrame, session_id: str, undo_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files as before the session, snapshots with the undo as a session of its own, warnings).

    The files are stored as they are under ``undo_id`` before they go back, so undoing the undo applies the session
    again; a file that has grown too large since is marked so in the new session. Sessions may be undone in any order:
    each goes back to what it found.
    """
    own = snapshots.filter(F.col("session_id") == session_id)
    now = snapshot(files, own.select(F.col("relpath").alias("file_path"), F.lit(None).cast("string").alias("new_path")), undo_id)
    after, warnings = undo(files, snapshots, session_id)
    return after, snapshots.unionByName(now), warnings


def record_session(applied: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``session_id, titles, n_ops, files``; sessions with nothing applied are left out. applied(session_id, title, op_idx)."""
    a = applied.groupBy("session_id").agg(F.array_sort(F.collect_set("title")).alias("titles"), F.count("*").alias("n_ops"))
    return a.join(snapshots.groupBy("session_id").agg(F.array_sort(F.collect_set("relpath")).alias("files")), "session_id")


def list_sessions(sessions: DataFrame, n: int = 10) -> DataFrame:
    return sessions.orderBy(F.desc("session_id")).limit(n)


def prune_sessions(sessions: DataFrame, keep: int = 50) -> DataFrame:
    return retain_newest(sessions, keep, None, "session_id", "session_id")


def plan_fixes(patches: DataFrame, min_confidence: float = 0.95, dry_run: bool = False) -> DataFrame:
    """Adds ``decision``: dry_run, apply or needs_review."""
    return patches.withColumn("decision", F.lit("dry_run") if dry_run else F.when(F.col("confidence") >= min_confidence, "apply").otherwise("needs_review"))


def auto_approvable(patches: DataFrame, min_confidence: float = 0.95) -> DataFrame:
    return patches.filter(F.col("confidence") >= min_confidence)


def diff_preview(ops: DataFrame) -> DataFrame:
    """Old and new lines of edit ops, with - and +."""
    mark = lambda sign, c: F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.concat(F.lit(sign), x))
    head = F.concat(F.lit("@@ "), "file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(" @@"))
    return ops.filter(F.col("op_type").isin("edit", "delete_lines")).select("patchset_id", "op_idx", F.array_join(F.concat(F.array(head), mark("-", F.col("old_content")), F.when(F.col("op_type") == "edit", mark("+", F.col("new_content"))).otherwise(F.array().cast("array<string>"))), "\n").alias("diff"))
