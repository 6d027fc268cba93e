"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import ship
from . import align, bpe, decontaminate, language, language_model, licenses, near_duplicates, nearest, quality, spelling, suffix_dedup, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words, items and verdict of every document against the whole benchmark."""
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of every document."""
    return bpe.digest(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and link components of every document, at four words and 85 hundredths."""
    return near_duplicates.near_duplicate_components(_table(spark, sf_dir, "documents"), 4, 85, 100)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for every hundredth vector."""
    return nearest.nearest(_table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier passage of 50 words or more, with their spans."""
    found = suffix_dedup.find_repeats(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of every document under two tokenizers."""
    return align.alignment(_table(spark, sf_dir, "documents"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, and its exact add-one unigram score."""
    docs = _table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.fit(docs.filter(~language_model.held_out())))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, its form and its root."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_nearest": op3_nearest,
    "op4_warc": op4_warc,
    "op5_bpe": op5_bpe,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_licenses": op7_licenses,
    "op8_url_filter": op8_url_filter,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language": op10_language,
    "op11_alignment": op11_alignment,
    "op12_language_model": op12_language_model,
    "op13_spelling": op13_spelling,
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[pos + 1 : pos + least(13, len(w))], ' ') AS g
      FROM i, unnest(range(len(w) - least(13, len(w)) + 1)) AS r(pos) WHERE len(w) > 0),
    dw AS (SELECT doc_id, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS g FROM d, (SELECT DISTINCT k FROM iw), unnest(range(len(w) - k + 1)) AS r(pos)),
    hit AS (SELECT doc_id, k, pos, item_id FROM dw JOIN iw USING (k, g)),
    n AS (SELECT doc_id, count(DISTINCT pos + j) AS n_hit FROM hit, unnest(range(k)) AS r(j) GROUP BY doc_id),
    m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op4_warc": """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM t""",
    "op7_licenses": licenses.oracle_sql(),
    "op9_suffix_dedup": f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 50], ' ') AS g FROM d, unnest(range(len(w) - 49)) AS r(pos) WHERE len(w) >= 50),
    later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS k FROM g) WHERE k > 1),
    gap AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS fresh FROM later),
    run AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM gap),
    span AS (SELECT doc_id, min(pos) AS a, max(pos) + 49 AS b FROM run GROUP BY doc_id, r),
    s AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS n_repeated, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM span GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_repeated, 0) AS n_repeated, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)""",
}
