"""Language by nearest centroid: TF-IDF vectors of letter n-grams (as UTF-8 bytes), several centroids per language, cosine.

Document frequencies cover all learning rows. For each language up to ``per_language`` rows (those with the least
hash) are clustered by spherical k-means into ``clusters`` centroids, in a task of its own. A text goes to the
language of its nearest centroid; it is marked ``rejected`` when even that is further off than nearly all of the
language's own sample was (``reject_share``), with a margin.

Learnt only from rows with a language whose crc32(doc_id as text) mod 4 is not 2. Defined cases: null, empty or
letterless texts, and all texts if nothing could be learnt, give ``und`` with score 0; repeated rows each get a
result; a null id is not held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _text as T
from ._features import Features, idf, tfidf
from .quality import held_out

PER_LANGUAGE, CLUSTERS, MAX_LANGUAGES, SHARES = 800, 4, 1000, 64
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


class Model:
    def __init__(self, features: Features, weights: np.ndarray, languages: list[str], centroids: np.ndarray, owner: np.ndarray, least: np.ndarray) -> None:
        self.features, self.weights, self.languages, self.centroids, self.owner, self.least = features, weights, languages, centroids, owner, least

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether rejected."""
        n = len(column)
        data, offsets = T.utf8(column)
        ascii_letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LETTERS[data], out=ascii_letters[1:])
        live = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        for i in np.flatnonzero(~live & (np.diff(offsets) > 0)).tolist():
            live[i] = any(c.isalpha() for c in column[i].as_py())
        if not self.languages:
            return ["und"] * n, np.zeros(n), np.zeros(n, bool)
        like = tfidf(self.features.counts(column), self.weights) @ self.centroids.T
        best = np.full((n, len(self.languages)), -1.0)
        for j, lang in enumerate(self.owner.tolist()):
            best[:, lang] = np.maximum(best[:, lang], like[:, j])
        pick = best.argmax(axis=1)
        top = best[np.arange(n), pick]
        share = np.exp((best - top[:, None]) / 0.02).sum(axis=1)
        lang = [self.languages[j] if ok else "und" for j, ok in zip(pick.tolist(), live.tolist(), strict=True)]
        return lang, np.where(live, 1 / share, 0.0), live & (top < self.least[pick])


def _centroids(clusters: int, reject_share: float, dim: int, weights: np.ndarray):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h", kind="stable")
        a = tfidf(np.vstack([np.frombuffer(x, np.float16) for x in group["x"]]).astype(np.float32), weights)
        middle = a[np.linspace(0, len(a) - 1, min(clusters, len(a))).astype(int)].copy()
        for _ in range(12):
            own = (a @ middle.T).argmax(axis=1)
            for j in range(len(middle)):
                if (own == j).any():
                    v = a[own == j].sum(axis=0)
                    middle[j] = v / max(float(np.sqrt(v @ v)), 1e-12)
        near = (a @ middle.T).max(axis=1)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "least": float(np.quantile(near, reject_share)) * 0.8, "v": [x.tobytes() for x in middle]})

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, reject_share: float = 0.005) -> Model:
    """Learn from the rows that are not held out and name a language; at most MAX_LANGUAGES of them."""
    features = Features(12, (1, 2, 3), letters=True)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(~held_out("id"))
    # The least hashes of each language: first within shares of it, so that no language is one task.
    hashed = rows.select("id", "lang", F.xxhash64("id", "text").alias("h")).withColumn("share", F.pmod("h", F.lit(SHARES)))
    rank = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy("h", "id"))
    ranked = hashed.withColumn("rank", rank("lang", "share")).filter(F.col("rank") <= per_language).withColumn("rank", rank("lang")).filter(F.col("rank") <= per_language)
    some = ranked.select("lang", "h").distinct()  # bounded: per_language rows for each of MAX_LANGUAGES languages
    n_languages = some.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the lang column holds something else")
    weights = idf(rows, features)
    if not n_languages:
        return Model(features, weights, [], np.zeros((0, features.dim), np.float32), np.zeros(0, np.int64), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, most=1 << 20):
            x = np.minimum(features.counts(batch.column(0)), 60000).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1), batch.column(2)], names=["x", "lang", "h"])

    sample = rows.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(some), ["lang", "h"]).select("text", "lang", "h").dropDuplicates(["lang", "h"])
    vectors = sample.mapInArrow(run, "x binary, lang string, h long")
    got = vectors.groupBy("lang").applyInPandas(_centroids(clusters, reject_share, features.dim, weights), "lang string, least double, v binary").toPandas().sort_values(["lang", "v"])
    languages = sorted(set(got["lang"]))
    owner = np.array([languages.index(x) for x in got["lang"]], np.int64)
    least = np.array([got[got["lang"] == x]["least"].iloc[0] for x in languages])
    return Model(features, weights, languages, np.vstack([np.frombuffer(v, np.float32) for v in got["v"]]), owner, least)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, most=1 << 20):
            lang, s, rejected = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(s), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")
