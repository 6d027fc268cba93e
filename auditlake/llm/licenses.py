"""License scans with DataFrame functions only: exact phrases, and an exact set-similarity join with templates.

Base: places where a phrase's words stand consecutively among the text's words. The method's own labels come from
text blocks: a template is found where a block's distinct words hold at least ``num / den`` of the template's. A
block is a line, or as many successive words over line ends as the template has, so that a notice wrapped at any
width is found and words of unrelated lines are not put together. With ``wrapped=False`` a block is a line alone.
The join orders words by how many blocks of the whole corpus hold them, rare ones first, and indexes
for each template only the prefix of ``t - need + 1`` words (one of which every match must hold). A candidate has
to pass the length filter (as many template words at all) and the positional filter (enough words left in both
orders from the first common one on) before its overlap is counted. Templates are a small fixed or given list; the
index and the word counts are bounded by it. Texts are read once: what is stored of a document, and read again by the
counts and the join, is its base columns and those of its blocks that hold enough template words of any kind.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Defined cases: null or empty texts have no
words, no labels (empty strings), null places and score 0; repeated rows each get a result; a null id is kept;
other columns are not read. Score: the best share of a template found, 1 where a base phrase is.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.clones import let
from ..shared import materialize

#: Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Templates of license lines and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
]
NUM, DEN = 4, 5


def normal(text: Column) -> Column:
    """The words of a text: a line end between those of two lines, a single blank between others."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # where lower() touches A-Z alone
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    blanks = F.regexp_replace(low, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.trim(F.regexp_replace(blanks, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _count(words: Column) -> Column:
    return F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def _places(words: Column, n_words: Column, phrase: str) -> Column:
    """``n, first, last`` of a phrase's starts among the words, null where it has none.

    Every word gets blanks of its own, so neighbours can both match.
    """
    own = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    wanted = f" {'  '.join(phrase.split())} "
    count = lambda p: F.size(F.filter(F.split(p, " +"), lambda w: w != "")).cast("long")
    last = lambda p: n_words - len(phrase.split()) - count(F.element_at(p, -1))
    found = let(F.split(own, wanted), lambda p: F.struct((F.size(p) - 1).cast("long").alias("n"), count(F.element_at(p, 1)).alias("first"), last(p).alias("last")))
    return F.when(F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(f" {phrase} ")), found)


def _rows(spark, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small local table by SQL VALUES."""
    text = lambda v: str(v) if isinstance(v, int) else "array(" + ",".join(f"'{x}'" for x in v) + ")" if isinstance(v, list) else f"'{v}'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows) + f" AS t({', '.join(columns)})")


def _blocks(lines: Column, reach: int, known: Column, least: int) -> Column:
    """``line, turn`` of each line with words that, with what follows, holds ``least`` known words.

    ``line``: all its known words; ``turn``: its last ``reach`` words with the next ``reach`` after it.
    """
    words = F.transform(F.split(lines, "\n"), lambda x: F.split(x, " "))
    heads = lambda ws: F.transform(ws, lambda w: F.slice(w, 1, reach))
    ends = lambda w: F.slice(w, F.greatest(F.size(w) - reach + 1, F.lit(1)), reach)
    after = lambda hs, i: F.slice(F.flatten(F.slice(hs, i + 2, reach)), 1, reach)
    cut = let(words, lambda ws: let(heads(ws), lambda hs: F.transform(ws, lambda w, i: F.struct(F.array_intersect(w, known).alias("line"), F.concat(ends(w), after(hs, i)).alias("turn")))))
    return F.filter(cut, lambda b: F.size(F.array_intersect(F.concat(b["line"], b["turn"]), known)) >= least)


class _Templates:
    """Templates as sets, and what a text must hold of them."""

    def __init__(self, templates: list[tuple[str, str]], num: int, den: int, wrapped: bool) -> None:
        self.spans = [len(t.split()) for t, _ in templates]
        self.reach = max(self.spans, default=1) - 1 if wrapped else 0
        self.sets = [(i, label, sorted(set(t.split()))) for i, (t, label) in enumerate(templates)]
        self.need = [-(-num * len(ws) // den) for _, _, ws in self.sets]
        self.vocabulary = sorted({w for _, _, ws in self.sets for w in ws})
        if not all(w.isascii() and w.isalnum() and w == w.lower() for w in self.vocabulary):
            raise ValueError("templates must consist of lower-case ASCII words")
        self.known = F.array(*[F.lit(w) for w in self.vocabulary])

    def blocks(self, lines: Column, words: Column) -> Column:
        """The blocks of a text that can hold a template; null where the whole text holds too few words of each."""
        held = F.array(*[F.struct(F.lit(n).alias("need"), F.array(*[F.lit(w) for w in ws]).alias("ws")) for n, (_, _, ws) in zip(self.need, self.sets, strict=True)])
        can = lambda own: F.exists(held, lambda t: F.size(F.array_intersect(own, t["ws"])) >= t["need"])
        own = F.array_intersect(F.split(words, " "), self.known)
        return F.when(let(own, can), _blocks(lines, self.reach, self.known, min(self.need, default=1)))

    def hits(self, stored: DataFrame) -> DataFrame:
        """``id, h, label, share`` of every block of ``stored(id, h, blocks)`` that holds enough of a template."""
        blocks = stored.filter("blocks is not null").select("id", "h", F.inline("blocks"))
        blocks = blocks.select("id", "h", "line", "turn", F.array_intersect(F.concat("line", "turn"), self.known).alias("words"))
        counts = dict(blocks.select(F.explode("words").alias("w")).groupBy("w").count().collect())  # at most the vocabulary
        order = {w: i for i, w in enumerate(sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        index = []
        for i, label, ws in self.sets:
            ws, need = sorted(ws, key=order.get), self.need[i]
            index += [(w, j, i, label, len(ws), need, ws, self.spans[i]) for j, w in enumerate(ws[: len(ws) - need + 1])]
        prefix = _rows(stored.sparkSession, index, ["w", "j", "template", "label", "t", "need", "t_words", "span"])
        ranks = F.map_from_arrays(self.known, F.array(*[F.lit(order[w]) for w in self.vocabulary]))
        placed = blocks.filter(F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted({r[0] for r in index})])))
        placed = placed.withColumn("words", F.array_sort("words", lambda a, b: F.element_at(ranks, a) - F.element_at(ranks, b)))
        tokens = placed.select("id", "h", "line", "turn", "words", F.size("words").alias("b"), F.posexplode("words").alias("i", "w"))
        pairs = tokens.join(F.broadcast(prefix), "w").filter("b >= need")  # length
        # From the first common word on, both sides have so many left; later common words repeat the pair.
        pairs = pairs.filter(F.col("i") == F.array_position("words", F.element_at(F.filter("words", lambda w: F.array_contains("t_words", w)), 1)) - 1)
        pairs = pairs.filter(F.least(F.col("b") - F.col("i"), F.col("t") - F.col("j")) >= F.col("need"))  # position
        most = lambda ws: F.size(F.array_intersect(ws, "t_words"))
        starts = F.sequence(F.lit(1), F.greatest(F.size("turn") - F.col("span") + 1, F.lit(1)))
        same = F.greatest(most("line"), F.array_max(F.transform(starts, lambda j: most(F.slice("turn", j, F.col("span"))))))
        pairs = pairs.filter(most("words") >= F.col("need"))  # a line and what follows hold enough: the block itself decides
        return pairs.withColumn("same", same).filter("same >= need").select("id", "h", "label", (F.col("same") / F.col("t")).alias("share"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, num: int = NUM, den: int = DEN, wrapped: bool = True) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per document row."""
    phrases = phrases if phrases is not None else PHRASES
    wanted = _Templates(templates if templates is not None else TEMPLATES, num, den, wrapped)
    text = F.col(f"`{text_col}`")
    lined = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), normal(text).alias("lines"))
    lined = lined.select("id", "h", "lines", F.replace("lines", F.lit("\n"), F.lit(" ")).alias("words"))  # a line end is no part of a word
    counted = lined.select("id", "h", "lines", "words", _count(F.col("words")).alias("n_words"))
    read = counted.select("id", "h", "n_words", *[_places(F.col("words"), F.col("n_words"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)], wanted.blocks(F.col("lines"), F.col("words")).alias("blocks"))
    of = lambda name: F.array(*[F.col(f"p{i}.{name}") for i in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.col(f"p{i}").isNotNull(), F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    n_base = F.aggregate(F.array_compact(of("n")), F.lit(0).cast("long"), lambda a, x: a + x)
    stored = materialize(read.select("id", "h", "n_words", n_base.alias("n_base"), F.array_min(of("first")).alias("first_word"), F.array_max(of("last")).alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("own"), "blocks"), "licenses")
    m = wanted.hits(stored).groupBy("id", "h").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")).alias("m")
    b = stored.drop("blocks").alias("b")
    joined = b.join(m, F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.h") == F.col("m.h")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return joined.select(F.col("b.id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("own", more)), ",").alias("labels"), score.alias("score"))


def oracle_sql() -> str:
    """DuckDB SQL for scan_licenses over ``documents`` with the fixed phrases and templates."""
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))}, {len(t.split())})" for t, label in TEMPLATES)
    words = "list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
    WITH d AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
    phrase(p, label, n) AS (VALUES {phrases}),
    template(label, t, span) AS (VALUES {templates}),
    place AS (SELECT doc_id, label, pos FROM d, phrase, unnest(range(len(w) - n + 1)) AS r(pos)
      WHERE array_to_string(w[pos + 1 : pos + n], ' ') = p),
    base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS own FROM place GROUP BY doc_id),
    line AS (SELECT doc_id, {words.format("l")} AS b FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) AS u(l)),
    near AS (SELECT doc_id, label, t, span, w FROM d, template WHERE {DEN} * len(list_intersect(w, t)) >= {NUM} * len(t)),
    block AS (SELECT doc_id, label, t, w[pos + 1 : pos + span] AS b FROM near, unnest(range(greatest(len(w) - span + 1, 1))) AS r(pos)
      UNION ALL SELECT doc_id, label, t, b FROM line, template),
    hit AS (SELECT doc_id, label, len(list_intersect(b, t))::DOUBLE / len(t) AS share FROM block WHERE {DEN} * len(list_intersect(b, t)) >= {NUM} * len(t)),
    more AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM hit GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
      coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
      greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END) AS score
    FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""
