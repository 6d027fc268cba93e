"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Writing: each task writes archives of at most ``archive_bytes`` of records to a folder that all executors share,
through pyarrow's file systems (file, hdfs, s3, ...). A dictionary is trained on the first records of each archive;
where they are too few for that, it is made of their first bytes as they stand, so every archive has one.
Names are unique to the attempt; the manifest, itself written as a table, names only files of attempts that
succeeded, so lost executors and retries leave strays but no doubles.

Reading: one row per archive of the manifest, streamed in pieces, never whole. Every record's frame, header lines,
Content-Length, end mark and payload digest are validated; ``strict`` raises on the first fault, otherwise the fault
stands in ``problem``.

Of records with equal payloads of at least ``least`` bytes that with the largest id is the response and the others
revisit it; all others are responses. Defined cases: a null payload is empty; a null url leaves its header out; a
null id is written as such and read back as null; repeated ids with one payload are responses all alike; an empty
table makes no archives and reads as no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import materialize, scratch_path

DICTIONARY_MAGIC = 0x184D2A5D
_FRAME_MAGIC = 0xFD2FB528
LEAST_BYTES, ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 32 << 20, 1 << 20, 32 << 10
_READ = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"


def _open(path: str, write: bool):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(at.rpartition("/")[0], recursive=True)
    # The name ends in .zst, which pyarrow would otherwise take as a wish to compress once more.
    return system.open_output_stream(at, compression=None) if write else system.open_input_stream(at, compression=None)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """``id, url, payload, digest, size, top``: top is the id of the response that a revisit refers to."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # Only digests are grouped, summed up within tasks first; a hot payload's rows are split by the skew join.
    tops = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("top"), F.count("*").alias("times")).filter("times > 1").select("digest", "size", "top")
    return rows.join(tops, ["digest", "size"], "left").select("id", "url", "payload", "digest", "size", F.when(F.coalesce(F.col("id") != F.col("top"), F.col("top").isNotNull()), F.col("top")).alias("top"))


def _record(ident, url, payload: bytes, digest: str, size: int, top) -> bytes:
    name = lambda x: f"<urn:page:{'null' if x is None else 'id-' + quote(str(x), safe='')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if top is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if top is None else 'revisit'}", f"WARC-Record-ID: {name(ident)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%-._|"))
    if top is not None:
        head += [f"WARC-Refers-To: {name(top)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]):
    """Trained on the records; where they are too few or too small for that, their own first bytes are the dictionary."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``plan_records`` rows; the manifest ``path, records, raw_bytes`` as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        waiting: list[bytes] = []
        state = {"file": None, "path": "", "records": 0, "raw": 0, "held": 0}

        def start() -> None:
            state["path"] = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            state["file"] = _open(state["path"], True)
            dictionary = _dictionary(waiting)
            raw = dictionary.as_bytes()
            state["file"].write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            state["zip"] = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
            for r in waiting:
                put(r)
            waiting.clear()

        def put(record: bytes) -> None:
            state["file"].write(state["zip"].compress(record))
            state["records"] += 1
            state["raw"] += len(record)

        def finish() -> pa.RecordBatch | None:
            if waiting:
                start()
            if state["file"] is None:
                return None
            state["file"].close()
            out = pa.RecordBatch.from_pylist([{"path": state["path"], "records": state["records"], "raw_bytes": state["raw"]}])
            state.update(file=None, records=0, raw=0, held=0)
            return out

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                record = _record(*(x.as_py() for x in row))
                if state["file"] is None:
                    waiting.append(record)
                    state["held"] += len(record)
                    if state["held"] >= SAMPLE_BYTES:
                        start()
                else:
                    put(record)
                if state["raw"] >= archive_bytes:
                    yield finish()
        if (last := finish()) is not None:
            yield last

    written = records.select("id", "url", "payload", "digest", "size", "top").mapInArrow(run, "path string, records long, raw_bytes long")
    return materialize(written, "warc-manifest")


def frames(stream) -> Iterator[bytes]:
    """The content of each frame of an archive; the dictionary comes from a leading skippable frame."""
    import zstandard

    held = stream.read(8)
    dictionary = None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_MAGIC:
        raw = stream.read(struct.unpack("<I", held[4:])[0])
        if struct.unpack("<I", raw[:4])[0] == _FRAME_MAGIC:  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
        dictionary, held = zstandard.ZstdCompressionDict(raw), b""
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        held = held or stream.read(1 << 20)
        if not held:
            return
        frame, parts = unzip.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            held = frame.unused_data
            if frame.eof:
                break
            held = stream.read(1 << 20)
            if not held:
                raise ValueError("an archive ends within a frame")
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """A record's fields; ``problem`` names the first fault that validation finds."""
    out = dict.fromkeys((c.split()[0] for c in _READ.split(", ")))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}
    ident = lambda v: None if v is None or v == "<urn:page:null>" else unquote(re.sub(r"^<urn:page:id-(.*)>$", r"\1", v))
    out |= {"record_type": fields.get("warc-type"), "record_id": ident(fields.get("warc-record-id")), "refers_to": ident(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri")}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out["payload_digest"] = digest or None
    length = fields.get("content-length", "")
    if not gap or not re.fullmatch(r"WARC/\d+\.\d+", lines[0]) or not all(":" in x for x in lines[1:]):
        return out | {"problem": "malformed header"}
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]:
        return out | {"problem": f"no {missing[0]}"}
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "wrong content-length"}
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    out["payload_bytes"] = int(told[1]) if told else len(payload)
    if out["record_type"] == "response":
        out["payload"] = payload
        if len(payload) != out["payload_bytes"] or hashlib.sha1(payload).hexdigest() != digest:
            out["problem"] = "payload does not match its length or digest"
    elif out["record_type"] == "revisit":
        if payload or out["refers_to"] is None:
            out["problem"] = "a revisit holds a payload or refers to nothing"
    else:
        out["problem"] = f"unexpected type {out['record_type']}"
    return out


def read_archives(manifest: DataFrame, strict: bool = True, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives named in ``path``; see ``parse_record``."""
    from pyspark.sql.types import _parse_datatype_string

    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _READ.split(", ")])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with _open(path, False) as stream:
                    for raw in frames(stream):
                        row = parse_record(raw)
                        if strict and row["problem"]:
                            raise ValueError(f"{path}: {row['problem']} in record {row['record_id']}")
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(raw) if with_payload else 300
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return manifest.select("path").repartition(n).mapInArrow(run, _parse_datatype_string(_READ))


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Archive the pages in ``folder`` (by default a new one in the shared scratch place) and read them back."""
    spark: SparkSession = pages.sparkSession
    manifest = write_archives(plan_records(pages, id_col, url_col, payload_col, least), folder or scratch_path(spark, "warc"))
    kind = pages.schema[id_col].dataType
    read = read_archives(manifest, with_payload=False)
    return read.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
