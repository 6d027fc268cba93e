"""Guidance packs: ``packs(name, description, extensions, imports, frameworks, languages, filename_patterns)`` and their activation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import glob_match

KINDS = ["extensions", "imports", "frameworks", "languages", "filename_patterns"]


def merge_packs(user: DataFrame, project: DataFrame) -> DataFrame:
    """All packs; a project's beats a user's of the same name."""
    mine = user.join(project.select("name"), "name", "left_anti")
    return project.withColumn("source", F.lit("project")).unionByName(mine.withColumn("source", F.lit("user")))


def activate(packs: DataFrame, repos: DataFrame) -> DataFrame:
    """``repo, name, reasons``: a pack is active where any kind of its rules matches; the first match of each kind is a reason.

    ``repos(repo, extensions, imports, frameworks, languages, filenames)``. Packs are few and broadcast against repos.
    """
    p = packs.select("name", *[F.coalesce(k, F.array().cast("array<string>")).alias(f"p_{k}") for k in KINDS])
    both = repos.join(F.broadcast(p))
    reasons = [F.when(F.arrays_overlap(f"p_{k}", k), F.concat(F.lit(k[:-1] + ": "), F.element_at(F.array_intersect(f"p_{k}", k), 1))) for k in KINDS[:4]]
    names = F.filter("filenames", lambda n: F.exists("p_filename_patterns", lambda g: glob_match(n, g)))
    reasons.append(F.when(F.size(names) > 0, F.concat(F.lit("filename: "), F.element_at(names, 1))))
    return both.withColumn("reasons", F.array_compact(F.array(*reasons))).filter(F.size("reasons") > 0).select("repo", "name", "reasons")
