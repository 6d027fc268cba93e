"""Clone detection: normalised code tokens, structural hashes, exact groups and near-duplicate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import qualified_name, split_lines
from ..shared import materialize
from .graph import connected_components
from .intervals import around

#: The token pattern, alternatives in order (so === is read as == and =).
TOKEN = r"(?U)//[^\n]*|/\*[\s\S]*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|=>|\.\.\.|\*\*=?|\+\+|--|\|\||&&|==|===|!=|!==|<=|>=|\+=|-=|\*=|/=|<<=?|>>=?|[{}\[\]().,;:?]|[+\-*/%=<>!&|^~]"
#: Words that keep their name.
KEYWORDS = [
    "abstract", "any", "as", "async", "await", "boolean", "break", "case", "catch", "class", "const", "constructor", "continue", "debugger",
    "declare", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "from", "function", "get", "if",
    "implements", "import", "in", "instanceof", "interface", "is", "keyof", "let", "module", "namespace", "never", "new", "null", "number", "of",
    "package", "private", "protected", "public", "readonly", "require", "return", "set", "static", "string", "super", "switch", "symbol", "this",
    "throw", "true", "try", "type", "typeof", "undefined", "unique", "unknown", "var", "void", "while", "with", "yield", "console", "Math", "Object",
    "Array", "String", "Number", "Boolean", "Promise", "Map", "Set", "JSON", "Error", "Date", "Symbol",
]
MIN_TOKENS, SHINGLE, THRESHOLD = 8, 5, 0.85
#: One structure in so many is looked at for common shingles; so many of these are told from others; so many ids of candidates are broadcast.
SAMPLED, COMMON, BROADCAST = 64, 1 << 18, 1 << 20


def let(value: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def tokens(body: Column | str) -> Column:
    """Normalised tokens: no comments, STR_ and NUM_ for literals, p1, p2 ... for other names in order of first sight."""
    body = F.col(body) if isinstance(body, str) else body
    raw = F.filter(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: ~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*"))))
    keep = F.array(*map(F.lit, KEYWORDS))
    is_name = lambda t: F.regexp_like(t, F.lit(r"^[A-Za-z_$]")) & ~F.array_contains(keep, t)
    word = lambda t, names: F.when(F.regexp_like(t, F.lit(r"^[\"'`]")), "STR_").when(F.regexp_like(t, F.lit(r"^(?U)\d")), "NUM_").when(is_name(t), F.concat(F.lit("p"), F.array_position(names, t).cast("string"))).otherwise(t)
    return let(raw, lambda r: let(F.array_distinct(F.filter(r, is_name)), lambda names: F.transform(r, lambda t: word(t, names))))


def shingles(toks: Column | str, k: int = SHINGLE) -> Column:
    """Distinct runs of k tokens; fewer tokens make one run."""
    toks = F.col(toks) if isinstance(toks, str) else toks
    runs = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " ")))
    return let(toks, lambda t: F.when(F.size(t) < k, F.array(F.array_join(t, " "))).otherwise(runs(t)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fingerprint_functions(functions: DataFrame, min_tokens: int = MIN_TOKENS, k: int = SHINGLE) -> DataFrame:
    """``id, path, name, line_start, line_end, n_tokens, structural_hash, shingles``; short bodies are left out."""
    fps = functions.withColumn("tokens", tokens("body")).filter(F.size("tokens") >= min_tokens)
    return fps.select(qualified_name("path", "enclosing_class", "name", "line_start").alias("id"), "path", "name", "line_start", "line_end", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("structural_hash"), shingles("tokens", k).alias("shingles"))


def duplicate_groups(fps: DataFrame, min_size: int = 2) -> DataFrame:
    """``structural_hash, n_members, representative``, largest first; the members are a table of their own."""
    groups = fps.groupBy("structural_hash").agg(F.count("*").alias("n_members"), F.min("id").alias("representative")).filter(F.col("n_members") >= min_size)
    return groups.orderBy(F.desc("n_members"), "representative")


def group_members(fps: DataFrame, groups: DataFrame) -> DataFrame:
    """``structural_hash, representative, id``: a row per member, so that a group of any size is no single row."""
    return fps.select("structural_hash", "id").join(groups.select("structural_hash", "representative"), "structural_hash").select("structural_hash", "representative", "id")


def clone_stats(fps: DataFrame) -> DataFrame:
    sizes = fps.groupBy("structural_hash").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("indexed"), F.count("*").alias("unique_structures"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("members"))


def _common_shingles(sets: DataFrame) -> np.ndarray:
    """Shingles that several documents of a sample hold, ``COMMON`` of them at most: they come last in each prefix.

    That bears on how many candidates there are, not on which pairs come out.
    """
    of = F.pmod(F.xxhash64("structural_hash", F.lit(1)), F.lit(SAMPLED)) == 0
    held = sets.filter(of).dropDuplicates(["structural_hash"]).select(F.explode("shingles").alias("s")).groupBy("s").count().filter("count > 2")
    return np.sort(held.orderBy(F.desc("count"), "s").limit(COMMON).select("s").toArrow().column(0).to_numpy())


def _with_prefix(sets: DataFrame, threshold: float, common: np.ndarray) -> DataFrame:
    """``structural_hash, id, n, prefix``: of each set the first n - ceil(tn) + 1 shingles, in one order for all sets."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            flat = flat[np.lexsort((flat, np.isin(flat, shared.value), row))]
            first = np.cumsum(sizes) - sizes
            most = np.where(sizes > 0, sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1, 0)
            kept = flat[np.arange(len(flat)) - first[row] < most[row]]
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(most, sizes))), pa.int32()), pa.array(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), prefix], names=["structural_hash", "id", "n", "prefix"])

    return sets.select("structural_hash", "id", "shingles").mapInArrow(run, f"structural_hash string, id {sets.schema['id'].dataType.simpleString()}, n int, prefix array<bigint>")


def near_duplicate_pairs(fps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``left, right, similarity`` of all pairs of different structures with Jaccard at or above the threshold, exactly.

    One representative per structure is joined (members follow by structural_hash), on 64-bit fingerprints of its
    shingles, stored once. Prefix filter: shingles are ordered by fingerprint, those that a sample finds common last, and
    a pair shares one of the first n - ceil(tn) + 1 of each. Only these are dealt; whole sets are, of candidates alone.
    """
    prints = F.transform("shingles", lambda s: F.xxhash64(s))
    sets = materialize(fps.select(F.col("structural_hash").cast("string").alias("structural_hash"), "id", prints.alias("shingles")), "clone-sets")
    prefixed = _with_prefix(sets, threshold, _common_shingles(sets)).groupBy("structural_hash").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    prefix = prefixed.select("id", "n", F.posexplode("prefix").alias("r", "s"))
    prefix = materialize(prefix.select("s", "id", "n", (F.col("r") + 1).alias("r")), "clone-prefixes")
    a, b = (prefix.select("s", F.col("id").alias(side), F.col("n").alias(f"n{k}"), F.col("r").alias(f"r{k}")) for side, k in (("left", "a"), ("right", "b")))
    pairs = a.join(b, "s").filter("left < right").filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    pairs = pairs.groupBy("left", "right").agg(F.count("*").alias("shared"), *[f(c).alias(c) for f, c in ((F.max, "ra"), (F.max, "rb"), (F.first, "na"), (F.first, "nb"))])
    # What two sets share beyond both prefixes lies behind the end of that which ends first, and behind their last meeting.
    behind = lambda n: F.ceil(F.col(n) * threshold - 1e-9) - 1
    more = F.greatest(F.least(behind("na"), F.col("nb") - F.col("rb")), F.least(behind("nb"), F.col("na") - F.col("ra")))
    pairs = pairs.filter(F.col("shared") + more >= (F.col("na") + F.col("nb")) * threshold / (1 + threshold) - 1e-9)
    pairs = materialize(pairs.select("left", "right"), "clone-candidates")
    asked = pairs.select(F.col("left").alias("id")).union(pairs.select("right")).distinct()
    if asked.count() <= BROADCAST:
        asked = F.broadcast(asked)
    sets = sets.join(asked, "id", "left_semi").select("id", "shingles")
    out = pairs.join(sets.select(F.col("id").alias("left"), F.col("shingles").alias("sa")), "left").join(sets.select(F.col("id").alias("right"), F.col("shingles").alias("sb")), "right")
    return out.select("left", "right", jaccard("sa", "sb").alias("similarity")).filter(F.col("similarity") >= threshold)


def near_duplicates(fps: DataFrame, target: str, threshold: float = THRESHOLD, top: int = 10) -> DataFrame:
    """The functions most like one target, other structures only."""
    own = fps.filter(F.col("id") == target).select(F.col("shingles").alias("ts"), F.col("structural_hash").alias("th"))
    hits = fps.join(F.broadcast(own), (F.col("structural_hash") != F.col("th")) & (F.col("id") != target)).withColumn("similarity", jaccard("shingles", "ts"))
    return hits.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(top).select("id", "path", "line_start", "similarity")


def clusters(pairs: DataFrame) -> DataFrame:
    """``node, component`` of near-duplicate pairs."""
    return connected_components(pairs, "left", "right")


def function_at(fps: DataFrame, points: DataFrame) -> DataFrame:
    """The innermost fingerprinted function around each point (path, line)."""
    hit = around(points, fps.select("id", "path", F.col("line_start").alias("a"), F.col("line_end").alias("b")), ["path"], "line", "a", "b")
    return hit.groupBy("path", "line").agg(F.min_by("id", F.struct((F.col("b") - F.col("a")), "a", "id")).alias("id"))


def dedup_patches(fps: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """Patch sets of one op that delete every member of a group but its representative; files(path, content) give the old lines."""
    gone = fps.join(groups.select("structural_hash", "representative"), "structural_hash").filter("id <> representative").join(files.select("path", "content"), "path", "left")
    old = F.array_join(F.slice(split_lines("content"), F.greatest("line_start", F.lit(1)), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))), "")
    none = F.lit(None).cast("string")
    return gone.select(F.concat(F.lit("dedup-"), F.substring("structural_hash", 1, 12), F.lit("-"), F.substring(F.sha1(F.col("id").cast("string")), 1, 12)).alias("patchset_id"), F.lit(0).alias("op_idx"), F.lit("delete_lines").alias("op_type"), F.col("path").alias("file_path"), "line_start", "line_end", old.alias("old_content"), none.alias("new_content"), none.alias("new_path"), F.concat(F.lit("duplicate of "), "representative").alias("reason"), F.lit(1.0).alias("confidence"))
