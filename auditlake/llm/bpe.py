"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last 8 bytes meets a mask. A chunk's ids are computed once and kept
under its 128-bit fingerprint in a bounded store of each Python worker, and reused for every later occurrence in
any document of any task that the worker runs. (One store for the whole cluster would mean a shuffle of all
texts and ids, some three times the input; it is not done.) At each join of two chunks the ids near the cut are
then replaced by those of a re-encoded stretch around it, which is widened until both of its ends are token ends
of the neighbouring chunks at places where the tokenizer always splits: from there on both agree exactly.

Encoding is by the tokenizers library's file and rules. Chunks of plain Latin text go through tiktoken with the
ranks of the same file, which is several times as fast and gives the same ids; anything else (rare controls, code
points from U+0240 on, special tokens) goes through tokenizers itself. Decoded bytes are compared with the text;
a text that differs is encoded again as a whole.

Defined cases: a null text counts as empty, with no ids; repeated rows each get a result; extra columns are not
read; an empty table gives no rows. Memory follows the batch (1 MB of text or one longer text) and ``store_mb``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest

from . import _text as T

LOG_CHUNK = 10
STORE_MB = 96
#: The pre-tokenizer's pattern, as the tokenizer file's ByteLevel step has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(rb"[^\t\n\r\x20-\x7e\x80-\xc8]|\xc2[\x80-\xa0]")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


def default_tokenizer() -> str:
    """The file of the public 50k byte-level BPE that is installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """Encodes and decodes whole texts with one tokenizer file."""

    _made: dict = {}

    @classmethod
    def of(cls, path: str, log_chunk: int = LOG_CHUNK, store_mb: int = STORE_MB) -> Codec:
        """One codec, and so one chunk store, for each Python worker."""
        key = (path, log_chunk, store_mb)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def __init__(self, path: str, log_chunk: int, store_mb: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        pre, decoder = held.get("pre_tokenizer") or {}, held.get("decoder") or {}
        if held["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or decoder.get("type") != "ByteLevel" or held.get("normalizer") or any(a.get(k) for a in held["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("the file must be a plain byte-level BPE without normaliser and prefix space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [a["content"].encode() for a in held["added_tokens"]]
        # ByteLevel writes printable Latin-1 bytes as themselves and the others, in order, from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        vocabulary = {t: i for t, i in held["model"]["vocab"].items() if t.encode() not in self.specials}
        pieces = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items()} | {a["id"]: a["content"].encode() for a in held["added_tokens"]}
        self.size = max(pieces) + 1
        self.bytes = [pieces.get(i, b"") for i in range(self.size)]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(self.size)]
        ranks = {pieces[i]: i for i in vocabulary.values()}
        # Ranks stand for merges only where merges are in the order of their results' ids.
        results = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in held["model"]["merges"]]
        self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if results == sorted(results) and sorted(ranks.values()) == list(range(len(ranks))) else None
        self.mask, self.most = np.uint32((1 << log_chunk) - 1), store_mb << 20
        self.store: dict[bytes, np.ndarray] = {}
        self.held = self.reused = self.encoded = 0

    def encode_bytes(self, raw: bytes) -> np.ndarray:
        """Ids of a whole string by the library, without chunks."""
        text = raw.decode()
        if self.fast is None or _ODD.search(raw) or any(x in raw for x in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.fast.encode_ordinary(text), np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, special tokens included."""
        held = self.bytes
        return b"".join([held[i] for i in ids.tolist()])

    def _chunk(self, raw: bytes) -> np.ndarray:
        key = xxh3_128_digest(raw)
        ids = self.store.get(key)
        if ids is None:
            ids = self.encode_bytes(raw)
            self.encoded += 1
            if self.held > self.most:
                self.store.clear()
                self.held = 0
            self.store[key] = ids
            self.held += 4 * len(ids) + 200
        else:
            self.reused += 1
        return ids

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids of each row of a column of texts, and the bytes that they decode to."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        if n:
            roll = _GEAR[data]
            for back in (1, 2, 4):  # doubling: after these, each place holds its last 8 bytes
                roll[back:] = roll[back:] + (roll[:-back] << np.uint32(back))
            cut[1:] |= ((roll >> np.uint32(12)) & self.mask) == 0
            cut[1:n] &= (data[1:] & 0xC0) != 0x80  # between characters
        # Where the pattern always splits: a blank after a letter and before a letter, all ASCII.
        safe = np.zeros(n + 1, bool)
        if n > 2:
            safe[1 : n - 1] = _LETTER[data[:-2]] & (data[1:-1] == 32) & _LETTER[data[2:]]
        safe[offsets] = True
        places, cuts = np.flatnonzero(safe), np.flatnonzero(cut)
        raw = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            inner = cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, b, "right")].tolist()
            if a == b:
                yield np.zeros(0, np.int32), b""
                continue
            if any(x in raw[a:b] for x in self.specials):  # a special token ends the stretch that the pattern sees
                ids = self.encode_bytes(raw[a:b])
                back = self.decode_bytes(ids)
            else:
                chunks = [self._chunk(raw[x:y]) for x, y in zip(inner[:-1], inner[1:], strict=True)]
                ids = self._joined(raw, inner, chunks, places)
                back = self.decode_bytes(ids)
                if back != raw[a:b]:
                    ids = self.encode_bytes(raw[a:b])
                    back = self.decode_bytes(ids)
            yield ids, back

    def _joined(self, raw: bytes, inner: list[int], chunks: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Ids of a row from its chunks', repaired at every join."""
        if len(chunks) == 1:
            return chunks[0]
        ends = [np.concatenate([[x], x + np.cumsum(self.length[c])]) for x, c in zip(inner[:-1], chunks, strict=True)]
        out, at, k = [], inner[0], 0  # ids stand up to the byte `at`, which is in chunk k
        while True:
            if k == len(chunks) - 1:
                out.append(chunks[k][np.searchsorted(ends[k], at) :])
                break
            join = inner[k + 1]
            left = int(np.searchsorted(places, join, "right")) - 1
            low = max(int(places[left]), at)
            while low > at and ends[k][np.searchsorted(ends[k], low)] != low:  # widen to the left
                left -= 1
                low = max(int(places[left]), at)
            right, to = int(np.searchsorted(places, join)), k + 1
            while True:  # widen to the right, over whole chunks where need be
                high = int(places[right])
                while to < len(chunks) and inner[to + 1] <= high < inner[-1]:
                    to += 1
                if high >= inner[-1] or ends[to][np.searchsorted(ends[to], high)] == high:
                    break
                right += 1
            if low > at:
                out.append(chunks[k][np.searchsorted(ends[k], at) : np.searchsorted(ends[k], low)])
            if high > low:
                out.append(self.encode_bytes(raw[low:high]))
            if high >= inner[-1]:
                break
            at, k = high, to
        return np.concatenate(out)


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", log_chunk: int = LOG_CHUNK, store_mb: int = STORE_MB) -> DataFrame:
    """``doc_id, n_tokens, ids`` for every whole text."""
    path = tokenizer or default_tokenizer()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, log_chunk, store_mb)
        for batch in T.slices(batches, most=1 << 20):
            rows = [ids for ids, _ in codec.encode_rows(*T.utf8(batch.column(1)))]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), ids], names=["doc_id", "n_tokens", "ids"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids; null ids give an empty text, broken UTF-8 the replacement character."""
    path = tokenizer or default_tokenizer()
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            texts = [codec.decode_bytes(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", log_chunk: int = LOG_CHUNK, store_mb: int = STORE_MB) -> DataFrame:
    """encode and decode in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    path = tokenizer or default_tokenizer()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, log_chunk, store_mb)
        sha, name = hashlib.sha256, codec.decimal
        for batch in T.slices(batches, most=1 << 20):
            n, ids, back = [], [], []
            for row, text in codec.encode_rows(*T.utf8(batch.column(1))):
                n.append(len(row))
                ids.append(sha(",".join([name[i] for i in row.tolist()]).encode()).hexdigest())
                back.append(sha(text.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
