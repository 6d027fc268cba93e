"""Guideline corpus: sections, greedy chunks, embeddings, an index on Parquet and similarity search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..shared import materialize
from .clones import let

CHUNK, TOP, MOST, DIM, QUERY_BLOCK = 1000, 5, 20, 256, 4096
#: Queries and vectors of one matrix product, and how much its scores may differ from sums in order.
SIDE, STEP, CLOSE = 256, 512, 1e-9


def split_sections(docs: DataFrame) -> DataFrame:
    """``source, section_index, section_title, text`` of docs(source, content), cut at headers of one to six #.

    Text before the first header is the Introduction; without any header the whole is the Document.
    """
    lines = docs.select("source", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    w = Window.partitionBy("source").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_like("line", F.lit(r"^#{1,6}\s+\S"))
    marked = lines.withColumns({"h": head, "s": F.sum(head.cast("int")).over(w)})
    text = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("i", "line")))), lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    secs = marked.groupBy("source", "s").agg(F.max(F.when(F.col("h"), F.regexp_replace(F.regexp_replace("line", r"^#{1,6}\s+", ""), r"\s+$", ""))).alias("title"), text.alias("text"), F.max(F.col("s")).alias("_"))
    total = F.max("s").over(Window.partitionBy("source"))
    out = secs.withColumn("n", total).filter((F.col("s") > 0) | (F.col("text") != ""))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("s")) - 1
    return out.select("source", rank.alias("section_index"), F.coalesce("title", F.when(F.col("n") == 0, "Document").otherwise("Introduction")).alias("section_title"), "text")


def chunk(text: Column | str, most: int = CHUNK, sep: str = "\n\n") -> Column:
    """Greedy paragraphs: a chunk grows while it and the next paragraph and a separator fit; a long paragraph stays whole."""
    text = F.col(text) if isinstance(text, str) else text
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(a: Column, p: Column) -> Column:
        over = (F.length(a["cur"]) + F.length(p) + 2 > most) & (a["cur"] != "")
        joined = F.when(a["cur"] == "", p).otherwise(F.concat(a["cur"], F.lit(sep), p))
        return F.struct(F.when(over, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"), F.when(over, p).otherwise(joined).alias("cur"))

    paragraphs = F.filter(F.transform(F.split(text, sep), F.trim), lambda p: p != "")
    end = lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])
    found = F.aggregate(paragraphs, start, step, end)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.substring(text, 1, most)))


def chunk_documents(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """``source, section_title, section_index, chunk_index, format, text``."""
    return split_sections(docs).select("source", "section_title", "section_index", F.posexplode(chunk("text", most)).alias("chunk_index", "text")).withColumn("format", F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1)))


def hashing_embedder(dim: int = DIM):
    """A deterministic embedder: signed word hashes, unit length. Any pandas UDF from string to array<float> can stand in."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        import zlib

        for texts in batches:
            out = []
            for text in texts.fillna(""):
                v = np.zeros(dim, np.float32)
                for w in re.findall(r"\w+", text.lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h >> 31 else -1
                n = float(np.sqrt(v @ v))
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return embed


def embed_chunks(chunks: DataFrame, embedder=None) -> DataFrame:
    return chunks.withColumn("embedding", (embedder or hashing_embedder())("text"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; null if either has no length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


class _Best:
    """The k best vectors of each query so far: by score, then by id.

    A matrix product finds what comes near a query's k-th score; that alone is then scored by a sum from the first
    component on, so that equal vectors have equal scores and the blocks make no difference.
    """

    def __init__(self, asked: np.ndarray, k: int) -> None:
        self.asked, self.k, self.least = asked, k, np.full(len(asked), -np.inf)
        self.q, self.at, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, at: np.ndarray, x: np.ndarray) -> None:
        """Vectors at the places ``at``, which ascend with their ids within equal vectors or are ranked again by id later."""
        for low in range(0, len(self.asked), SIDE):
            own = self.asked[low : low + SIDE]
            near = own @ x.T
            least = self.least[low : low + SIDE]
            if len(x) >= self.k:
                np.maximum(least, np.partition(near, len(x) - self.k, axis=1)[:, len(x) - self.k] - CLOSE, out=least)
            q, v = np.nonzero(near >= least[:, None])
            if len(q):
                self._keep(q + low, at[v], np.cumsum(own[q] * x[v], axis=1)[:, -1])

    def _keep(self, q: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        low, high = q[0], q[-1]
        mine = (self.q >= low) & (self.q <= high)
        q, at, score = (np.concatenate([a[mine], b]) for a, b in ((self.q, q), (self.at, at), (self.score, score)))
        order = np.lexsort((at, -score, q))
        q, at, score = q[order], at[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last] - CLOSE)
        kept = rank < self.k
        self.q, self.at, self.score = (np.concatenate([a[~mine], b[kept]]) for a, b in ((self.q, q), (self.at, at), (self.score, score)))


def search(chunks: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "chunk_id", query_id: str = "query_id") -> DataFrame:
    """The k (1 to 20) most similar chunks of each query (query_id, embedding), exactly.

    Queries are a stated set, broadcast in blocks of about QUERY_BLOCK. Vectors are brought to unit length once; a task
    compares blocks of its chunks with all queries of a block by a matrix product and keeps its own k best per query
    before the shuffle. Vectors with null or non-finite components take no part; those of other lengths are not compared.
    """
    k = max(1, min(MOST, k))
    unit = lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(c, lambda x: x.cast("double") / n)))
    asked = materialize(queries.select(query_id, unit("embedding").alias("_q")).filter("_q is not null"), "search-queries")
    given = chunks.select(id_col, unit("embedding").alias("_v")).filter("_v is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = ", ".join(f"`{n}` {d.schema[c].dataType.simpleString()}" for n, d, c in ((query_id, asked, query_id), (id_col, given, id_col))) + ", score double"
    scored = None
    for i in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i).toArrow()  # about QUERY_BLOCK queries
        shared = chunks.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            named, lists = shared.value.column(0), shared.value.column(1).combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            best = {int(n): (np.flatnonzero(sizes == n), _Best(flat[(starts[sizes == n][:, None] + np.arange(n)).ravel()].reshape(-1, n), k)) for n in np.unique(sizes)}
            ids: dict = {n: [] for n in best}
            for batch in batches:
                own, wide = batch.column(0), np.diff(batch.column(1).offsets.to_numpy())
                parts, begin = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(wide) - wide
                order = np.array(pc.sort_indices(own))  # ties go to the smaller id
                for n, (_, found) in best.items():
                    rows = order[wide[order] == n]
                    for low in range(0, len(rows), STEP):
                        some = rows[low : low + STEP]
                        first = sum(map(len, ids[n]))
                        ids[n].append(own.take(pa.array(some)))
                        found.add(np.arange(first, first + len(some)), parts[(begin[some][:, None] + np.arange(n)).ravel()].reshape(-1, n))
            for n, (places, found) in best.items():
                if len(found.q):
                    yield pa.RecordBatch.from_arrays([named.take(pa.array(places[found.q])).combine_chunks(), pa.concat_arrays(ids[n]).take(pa.array(found.at)), pa.array(found.score)], names=[query_id, id_col, "score"])

        part = given.mapInArrow(run, schema)
        scored = part if scored is None else scored.unionByName(part)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def write_index(chunks: DataFrame, path: str) -> None:
    """Rebuild the index, partitioned by a hash of the source so that one source can be replaced alone."""
    chunks.withColumn("source_hash", F.pmod(F.xxhash64("source"), F.lit(64))).write.mode("overwrite").partitionBy("source_hash").parquet(path)


def replace_sources(chunks: DataFrame, path: str) -> None:
    """Delete-by-source and append: only the touched hash partitions are written again."""
    spark = chunks.sparkSession
    fresh = chunks.withColumn("source_hash", F.pmod(F.xxhash64("source"), F.lit(64)))
    touched = [r[0] for r in fresh.select("source_hash").distinct().collect()]  # 64 at most
    held = spark.read.parquet(path).filter(F.col("source_hash").isin(touched)).join(fresh.select("source").distinct(), "source", "left_anti")
    out = materialize(held.unionByName(fresh, allowMissingColumns=True), "index")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_hash").parquet(path)


def delete_source(spark: SparkSession, path: str, source: str) -> None:
    """Take a source's chunks out of the index; only its hash partition is written again."""
    held = spark.read.parquet(path).filter(F.col("source_hash") == F.pmod(F.xxhash64(F.lit(source)), F.lit(64)))
    out = materialize(held.filter(F.col("source") != source), "index")
    if out.isEmpty():  # an overwrite without rows would leave the partition as it is
        out = materialize(spark.read.parquet(path).filter(F.col("source") != source), "index")
        out.write.mode("overwrite").partitionBy("source_hash").parquet(path)
    else:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_hash").parquet(path)


def list_sources(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks"))
