"""Alignment, language model and spelling variants against brute force, with nulls, empty and long texts, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditlake.llm import align, language_model, nearest, spelling

#: Extra columns have the names that the operators use themselves.
DOCS = "doc_id long, text string, row long, a array<int>, pair long, n long, word string, gram long, levels binary, slot int, score double, lang string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, [1], 2, 3, "w", 4, b"", 5, 0.5, "x") for i, t in rows], DOCS).repartition(4)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    plain = ["The quick brown fox's fur isn't red.", "Élan vital à l'œuvre, ça va", "one", " ", "  two  blanks ", "tab\there \n\n  new", "<|endoftext|> <s> x <unk> <0x41>", "nbsp  x   y", "日本語 テキスト。そして", "▁odd ▁x", "emoji 😀😀 é", "　 a", "÷ b × c", "\x00 z", "ﬁ ½ Å"]
    nasty = ["".join(rng.choice("  abé'▁\n\t1.日😀<>|Ã ") for _ in range(rng.randint(1, 40))) for _ in range(120)]
    words = ["alpha", "beta", "gamma", "delta's", "épsilon", "zeta,", "The", "of"]
    return [None, "", *plain, *plain[:3], *nasty, " ".join(rng.choice(words) for _ in range(300)), "long " * 30000]


def aligned(texts):
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(shown))}
    rows, count = [], Counter()
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            rows.append(([], [], [], ""))
            continue
        ends = [np.concatenate([[0], np.cumsum([len(x) for x in p])]).tolist() for p in parts]
        links, j = [], 0
        for i in range(len(ids[0])):
            while ends[1][j + 1] <= ends[0][i]:
                j += 1
            k = j
            while k < len(ids[1]) and ends[1][k] < ends[0][i + 1]:
                links.append((ids[0][i], ids[1][k]))
                k += 1
        common = sorted(set(ends[0]) & set(ends[1]))
        place = [{e: i for i, e in enumerate(x)} for x in ends]
        groups = ["|".join(",".join(map(str, ids[s][place[s][x] : place[s][y]])) for s in (0, 1)) for x, y in zip(common, common[1:])]
        rows.append((*ids, links, ";".join(groups)))
        count.update(set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(len(x), len(y), len(g.split(";")) if g else 0, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for x, y, links, g in rows]


@pytest.mark.parametrize("most", [align.MOST_PAIRS, 200])
def test_alignment_equals_brute_force(spark, texts, most):
    got = align.alignment(table(spark, enumerate(texts)), most_pairs=most, store_mb=1)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert rows == dict(enumerate(aligned(texts)))


def test_gallop_finds_lower_bounds():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 50), (7, 300), (64, 64), (500, 501)):
        long = np.cumsum(rng.integers(1, 9, m))
        short = np.unique(np.append(rng.integers(1, long[-1] + 1, n), long[-1]))
        assert (align.gallop(short, long) == np.searchsorted(long, short)).all()
    assert len(align.gallop(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_empty_tables_and_null_ids(spark):
    none = table(spark, [])
    assert align.alignment(none).count() == 0
    assert language_model.score(none, language_model.fit(none)).count() == 0
    assert spelling.variants(none).count() == 0
    rows = table(spark, [(None, "a b"), (None, "a b"), (5, None)])
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in align.alignment(rows).collect()) == [(False, 0, 0), (True, 2, 4), (True, 2, 4)]
    assert sorted(r.n_tokens for r in language_model.score(rows, language_model.fit(rows)).collect()) == [1, 3, 3]


def test_language_model(spark, texts):
    rng = random.Random(8)
    vocabulary = ["der", "die", "das", "Haus", "Baum", "grün", "ist", "x1"]
    chain = lambda: " ".join(w for _ in range(60) for w in (lambda i: (vocabulary[i], vocabulary[(i + 3) % 8]))(rng.randrange(8)))
    rows = [*enumerate(texts), *((1000 + i, chain()) for i in range(60)), (None, "der Baum")]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["</s>"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    count = Counter(w for t in train for w in t)
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(i), h, len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t), 6)) for (i, _), t, h in zip(rows, tokens, held, strict=True))
    docs = table(spark, rows)
    model = language_model.fit(docs.filter(~language_model.held_out()), log_slots=2)
    scores = {}
    for part_mb, most in ((language_model.PART_MB, language_model.MOST_WORDS), (0, 3)):
        got = language_model.score(docs, model, part_mb=part_mb, most_words=most).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        scores[part_mb] = {r.doc_id: r.score for r in got}
    assert scores[0] == pytest.approx(scores[language_model.PART_MB])  # in parts or as one, the filter says the same
    # The same smoothing over exact quantised counts: the filter may only find too much, and seldom.
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    count["<s>"] = len(train)
    mean = lambda n: (3 * 2 ** (n.bit_length() - 1) - 1) / 2 if n else 0.0
    exact = {}
    for (i, _), t in zip(rows, tokens, strict=True):
        exact[i] = 0.0
        for x, y in zip(["<s>", *t], t):
            p, c = (mean(count[y]) + 1) / (total + distinct + 1), mean(count[x])
            exact[i] += math.log10((min(mean(pairs[x, y]), c) + language_model.MU * p) / (c + language_model.MU))
    off = [abs(scores[0][i] - exact[i]) / len(t) for (i, _), t in zip(rows, tokens, strict=True)]
    assert np.mean(off) < 0.05
    known = [r for r in got if r.doc_id and r.doc_id >= 1000 and r.held_out]
    assert known
    assert all(r.score > r.base_score for r in known)  # pairs of words tell more than words alone


def test_filter_has_all_levels_and_few_others(spark):
    docs = table(spark, [(i, " ".join(f"w{j}" for j in range(i % 40 + 1))) for i in range(200)])
    model = language_model.fit(docs, order=1)
    held = next(model.parts(64))
    rows = model.grams.collect()
    keys = np.array([r.gram for r in rows]).view(np.uint64)
    true = np.array([r.n.bit_length() for r in rows])
    assert (held.level(keys) >= true).all()
    assert (held.level(keys) == true).mean() > 0.9
    assert (held.level(np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) > 0).mean() < 0.1


def variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in words:
                near[w].add(x)
                near[x].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root(w)) for w, n in words.items()}


@pytest.mark.parametrize("options", [{}, {"block": 20, "groups": 3}, {"block": 1, "groups": 2}])
def test_spelling_variants_equal_brute_force(spark, options):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.choice([7, 8, 9, 10]))) for _ in range(30)]

    def vary(w):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:at] + w[at + 1 :] if kind == 0 else w[:at] + rng.choice("abÿ") + w[at + (kind == 1) :]

    rows = [(i, " ".join(w if rng.random() < 0.8 else vary(w if rng.random() < 0.8 else vary(w)) for w in (base[int(rng.random() ** 3 * 30)] for _ in range(30)))) for i in range(200)]
    chain = ["aaaaaaaaa", "aaaaaaaab", "aaaaaaabb"]
    rows += [(2000 + i, w) for n, w in zip((4, 60, 700), chain, strict=True) for i in range(n)]
    long = "abcdefgh" * 40
    rows += [(None, "Hello×÷World hellooo 日本anticon ANTICON anticon"), (7, None), (8, ""), (9, f"{long} {long} {long[1:]} {long[1:]} {long[:-1]}x {long[:-1]}x")]
    got = {r.word: tuple(r)[1:] for r in spelling.variants(table(spark, rows), **options).collect()}
    want = variants(rows)
    assert got == want
    assert want["aaaaaaaaa"][2] == "aaaaaaaab"
    assert want["aaaaaaaaa"][4] == "aaaaaaabb"


@pytest.mark.parametrize("most", [nearest.MOST_BEAM, 4])
def test_search_widens_until_probes_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "MOST_BEAM", most)  # with 4 no beam is wide enough: all vectors are compared
    x = np.random.default_rng(0).standard_normal((1200, 48))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1200, x[0].tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = nearest.nearest(rows, degree=6, beam=11, every=40).collect()
    want = {(r.query_id, r.vec_id) for r in nearest.brute_force(rows, every=40).collect()}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found) == len(want)
    assert len(found & want) >= (0.9 if most > 4 else 1) * len(want)
    assert (0, 1200) in found
