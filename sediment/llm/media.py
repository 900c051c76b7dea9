"""Media columns: signature sniffing, format validation, type correction and carving.

An Aho-Corasick automaton locates magic bytes at every offset; the validator of that format confirms
structure and length, which gives the true type of a blob and the media embedded in it. `to_wave`
stores any payload losslessly as 8-bit PCM samples; `wave_samples` reads them back.

Defined results: a null or empty blob has no type, is not valid and holds nothing; equal blobs have
equal results; a declared type is corrected only if a validator confirms another one at offset 0.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import materialize, table

#: Fixed values of the formats: magic bytes and the media type they announce.
MAGIC = (
    (b"RIFF", "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b\x08", "application/gzip"),
    (b"OggS", "audio/ogg"),
    (b"fLaC", "audio/flac"),
)
RATE, CHANNELS = 16_000, 1
BLOCK, PAD = 192, b"\x20"


@cache
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        out.add_word(magic.decode("latin-1"), (magic, kind))
    out.make_automaton()
    return out


def wav_length(b: bytes, at: int) -> int:
    """Bytes of a RIFF/WAVE file whose chunks fill it exactly and that has a format before its data; otherwise 0."""
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    total = 8 + struct.unpack_from("<I", b, at + 4)[0]
    if at + total > len(b):
        return 0
    p, end, seen = at + 12, at + total, []
    while p + 8 <= end:
        name, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        seen.append(name)
        p += 8 + n + (n & 1)
    return total if p == end and b"fmt " in seen and b"data" in seen and seen.index(b"fmt ") < seen.index(b"data") else 0


@lru_cache(maxsize=8)
def _places(b: bytes, mark: bytes) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(mark), b)]


def _find(b: bytes, mark: bytes, at: int) -> int:
    """b.find(mark, at), with one search for all signatures of a blob."""
    places = _places(b, mark)
    k = bisect_left(places, at)
    return places[k] if k < len(places) else -1


def png_length(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (first and name != b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if name == b"IEND":
            return p - at
    return 0


def gif_length(b: bytes, at: int) -> int:
    if len(b) < at + 14:
        return 0
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def jpeg_length(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        if b[p + 1] == 0xDA:
            end = _find(b, b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else 0
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return 0
        p += 2 + n
    return 0


def pdf_length(b: bytes, at: int) -> int:
    end = _find(b, b"%%EOF", at)
    return end + 5 - at if end >= 0 and 0 <= _find(b, b"startxref", at) <= end - 9 else 0


def zip_length(b: bytes, at: int) -> int:
    end = _find(b, b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else 0


def gzip_length(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(d.unused_data) - at if d.eof else 0


def ogg_length(b: bytes, at: int) -> int:
    p, last = at, False
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0 and not last:
        n, last = b[p + 26], bool(b[p + 5] & 4)
        if p + 27 + n > len(b):
            return 0
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
    return p - at if last and p <= len(b) else 0


def flac_length(b: bytes, at: int) -> int:
    """Only the metadata blocks have lengths; audio frames run to the end of the blob."""
    p, k = at + 4, 0
    while p + 4 <= len(b):
        kind, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if k == 0 and (kind & 0x7F != 0 or n != 34):
            return 0
        p, k = p + 4 + n, k + 1
        if kind & 0x80:
            return len(b) - at if p <= len(b) else 0
    return 0


VALID = {
    "audio/wav": wav_length, "image/png": png_length, "image/gif": gif_length, "image/jpeg": jpeg_length, "application/pdf": pdf_length,
    "application/zip": zip_length, "application/gzip": gzip_length, "audio/ogg": ogg_length, "audio/flac": flac_length,
}


def sniff(blob: bytes | None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The confirmed type at offset 0, and (offset, length, type) of all confirmed media that start later, nested ones too."""
    if not blob:
        return None, []
    found: list[tuple[int, int, str]] = []
    for end, (magic, kind) in automaton().iter(blob.decode("latin-1")):
        at = end + 1 - len(magic)
        if n := VALID[kind](blob, at):
            found.append((at, n, kind))
    own = next((k for at, _, k in found if at == 0), None)
    return own, sorted(x for x in found if x[0] > 0)


def to_wave(payload: bytes) -> bytes:
    """The payload as the samples of an unsigned 8-bit mono PCM wave file."""
    pad = b"\0" * (len(payload) & 1)
    return b"".join((b"RIFF", struct.pack("<I", 36 + len(payload) + len(pad)), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, CHANNELS, RATE, RATE * CHANNELS, CHANNELS, 8), b"data", struct.pack("<I", len(payload)), payload, pad))


def wave_samples(blob: bytes) -> bytes:
    """The samples of the first data chunk; an error if the blob is not a valid wave file."""
    if not wav_length(blob, 0):
        raise ValueError("not a wave file")
    p = 12
    while blob[p : p + 4] != b"data":
        n = struct.unpack_from("<I", blob, p + 4)[0]
        p += 8 + n + (n & 1)
    return blob[p + 8 : p + 8 + struct.unpack_from("<I", blob, p + 4)[0]]


SNIFFED = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("valid", T.BooleanType()), T.StructField("corrected", T.BooleanType()),
    T.StructField("carved", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())]))),
])


def sniff_media(df: DataFrame, blob: str = "media", declared: str | None = "declared") -> DataFrame:
    """Append `sniffed`: the type (confirmed, else declared), if it was confirmed, if it corrects the declared one, and what is embedded."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(SNIFFED)
    def run(blobs: pa.Array, types: pa.Array) -> pa.Array:
        out = []
        for b, t in zip(blobs, types, strict=True):
            said = t.as_py()
            own, inside = sniff(b.as_py())
            out.append({"type": own or said, "valid": own is not None, "corrected": own is not None and own != said, "carved": [{"offset": o, "length": n, "type": k} for o, n, k in inside]})
        return pa.array(out, pa.struct([("type", pa.string()), ("valid", pa.bool_()), ("corrected", pa.bool_()), ("carved", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))]))

    return df.withColumn("sniffed", run(F.col(blob), F.col(declared) if declared else F.lit(None).cast("string")))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text (null: empty) padded to a positive multiple of BLOCK bytes, as a wave file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for at in range(0, len(ids), 256):
                part = [(t.as_py() or "").encode() for t in texts[at : at + 256]]
                media = [to_wave(t + PAD * (max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t))) for t in part]
                yield pa.RecordBatch.from_arrays([ids[at : at + 256], pa.array([len(t) for t in part], pa.int64()), pa.array(["text/plain"] * len(part)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read stored media back: digests of the payload, digests of the stored form, and what sniffing says of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rows = []
            for i, n, said, blob in zip(*(batch.column(names.index(c)) for c in ("doc_id", "n_bytes", "declared", "media")), strict=True):
                b = blob.as_py()
                own, inside = sniff(b)
                payload = wave_samples(b)
                feature = f"{said.as_py()}->{own};samples={len(payload)};levels={len(set(payload))};embedded=" + ",".join(f"{k}@{o}+{m}" for o, m, k in inside)
                rows.append((i.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(b), hashlib.sha256(b).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(materialize(store_texts(table(spark, sf_dir, "documents"))))
