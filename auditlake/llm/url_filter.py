"""URL filter: rules first; then host words by unigram Viterbi segmentation and multinomial naive Bayes.

The word counts come from the visible words of all pages. Host names are taken apart at whatever is no letter; each
distinct piece is segmented into words by the most likely split, for which a join brings the counts of exactly
those of its substrings that are words (no vocabulary is broadcast). Naive Bayes learns, from all pages that a rule
decides, how often the tokens of segmented hosts and of paths occur with either verdict, in 2**16 hashed buckets
(a bound on what reaches the driver), and decides the pages that no rule fits.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
``#`` or the end. A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's;
the longest wins. Defined cases: a null url, or one without ``://``, has an empty host and path and no tokens, and
gets the more frequent verdict among ruled pages (``allow`` in doubt); repeated rows each get a verdict; other
columns are not read; null html gives no words.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shared import materialize

#: The rules, as (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
LOG_BUCKETS = 16
_GAP = r"[^\p{L}]+"


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """``word, n`` of all runs of letters in the visible text, A-Z lower-cased."""
    visible = F.regexp_replace(F.col(f"`{text_col}`"), r"<[^>]*>", " ")
    low = F.translate(visible, string.ascii_uppercase, string.ascii_lowercase)
    words = pages.select(F.explode(F.split(low, _GAP)).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(piece: str, spans: list[tuple[int, int, int]], total: int) -> list[str]:
    """The most likely split of a piece; (start, end, count) of its substrings that are words. Ties: the shorter last word.

    A stretch of letters that is no word costs more the longer it is, so only its start has to be kept, and the work
    grows with the piece and its words.
    """
    fresh = math.log(total + 1)
    ends: dict[int, list[tuple[int, int]]] = {}
    for a, b, n in spans:
        ends.setdefault(b, []).append((a, n))
    best, back, cost, start = [0.0], [0], math.inf, 0
    for b in range(1, len(piece) + 1):
        if best[-1] + fresh + 2.5 <= cost + 2.5 + 1e-12:
            cost, start = best[-1] + fresh + 2.5, b - 1
        else:
            cost += 2.5
        ways = sorted([(b - a, best[a] + fresh - math.log(n)) for a, n in ends.get(b, ())] + [(b - start, cost)])
        length, least = ways[0]
        for way, c in ways[1:]:
            if c < least - 1e-12:
                length, least = way, c
        best.append(least)
        back.append(b - length)
    out, b = [], len(piece)
    while b:
        out.append(piece[back[b] : b])
        b = back[b]
    return out[::-1]


def segment_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``host, words``: the words of each distinct host, piece by piece.

    A piece is looked up by its substrings of all lengths that some word has.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    piece = F.filter(F.split("host", _GAP), lambda p: p != "")
    taken = hosts.select("host").distinct().select("host", F.posexplode(piece).alias("place", "piece"))
    pieces = taken.select("piece").distinct()
    most = pieces.agg(F.max(F.length("piece"))).first()[0] or 0
    lengths = [r[0] for r in words.select(F.length("word").alias("m")).filter(F.col("m") <= most).distinct().collect()]  # no more than a piece has letters
    starts = pieces.select("piece", F.explode(F.lit(sorted(lengths)).cast("array<int>")).alias("m")).filter(F.length("piece") >= F.col("m"))
    spans = starts.select("piece", "m", F.explode(F.sequence(F.lit(0), F.length("piece") - F.col("m"))).alias("a"))
    spans = spans.select("piece", "a", (F.col("a") + F.col("m")).alias("b"), F.substring("piece", F.col("a") + 1, F.col("m")).alias("word"))
    known = spans.join(words, "word").groupBy("piece").agg(F.collect_list(F.struct("a", "b", "n")).alias("spans"))  # bounded by the piece's length
    ready = pieces.join(known, "piece", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [viterbi(p, [(s["a"], s["b"], s["n"]) for s in spans or ()], total) for p, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["piece", "split"])

    split = ready.select("piece", "spans").mapInArrow(run, "piece string, split array<string>")
    joined = taken.join(split, "piece").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "split"))).alias("x"))
    return joined.select("host", F.flatten(F.col("x.split")).alias("words"))


def _buckets(words: list[str] | None, path: str) -> list[int]:
    tokens = ["h:" + w for w in words or ()] + ["p:" + re.sub(r"[0-9]+", "0", t) for t in re.split(r"[\W_]+", path.lower()) if t]
    return [zlib.crc32(t.encode()) & ((1 << LOG_BUCKETS) - 1) for t in tokens]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` (score: the method's likelihood of block, also where a rule decides)."""
    host, path = parts_of(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    words = materialize(word_counts(pages, text_col), "url-words")
    split = materialize(segment_hosts(rows, words), "url-hosts")  # a table of its own, so that the join can split a hot host
    tokens = materialize(rows.join(split, "host", "left"), "url-tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, (1 << LOG_BUCKETS) + 1), np.int64)
        for batch in batches:
            for w, p, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = seen[int(said == "block")]
                own[-1] += 1
                for b in _buckets(w, p):
                    own[b] += 1
        for k in (0, 1):
            used = np.flatnonzero(seen[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), pa.array(seen[k][used])], names=["k", "bucket", "n"])

    counts = np.zeros((2, (1 << LOG_BUCKETS) + 1))
    learnt = tokens.filter("ruled is not null").select("words", "path", "ruled").mapInArrow(count, "k long, bucket long, n long")
    for k, bucket, n in learnt.groupBy("k", "bucket").agg(F.sum("n")).collect():  # at most 2 * (2**16 + 1) rows
        counts[k, bucket] = n
    docs, seen = counts[:, -1], counts[:, :-1] + 1
    weight = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    prior = math.log((docs[1] + 1) / (docs[0] + 1)) if docs.sum() else -1.0
    if docs.min() == 0:  # one verdict only: nothing tells tokens apart
        weight = np.zeros_like(weight)
    model = pages.sparkSession.sparkContext.broadcast(weight)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.array([prior + sum(model.value[b] for b in _buckets(w, p)) for w, p in zip(batch.column(5).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.float64)
            said = [r or ("block" if o > 0 else "allow") for r, o in zip(batch.column(4).to_pylist(), odds.tolist(), strict=True)]
            score = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(said, pa.string()), pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return tokens.select("page_id", "host", "path", "rule", "ruled", "words").mapInArrow(decide, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
