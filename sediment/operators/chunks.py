"""Content-defined chunking, content addresses, compression, encryption and the chunk store's set operations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Eight interleaved lanes of a 32-step gear hash, the split mask, and the default sizes.
LANES, STEPS = 8, 32
SPLIT_MASK = 0xFFFFF800
MIN_SIZE, MAX_SIZE = 256 * 1024, 20 * 1024 * 1024
WINDOW = LANES * STEPS


@cache
def gear_table(seed: bytes) -> np.ndarray:
    """256 32-bit numbers, a function of the seed alone."""
    raw = b"".join(hashlib.sha256(seed + bytes([k])).digest() for k in range(32))
    return np.frombuffer(raw, "<u4").copy()


def window_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hash at each byte since the last reset: each lane's gear values, shifted by their age and added up modulo 2**32.

    Doubling steps: a sum over 2k ages is the sum over k ages, and that of k positions earlier in the lane shifted by k."""
    out = table[data].astype(np.uint32)
    age = 1
    while age < STEPS:
        back = LANES * age
        if back >= len(out):
            break
        older = out[:-back] << np.uint32(age)
        out = out.copy()
        out[back:] += older
        age *= 2
    return out


def split_points(data: bytes | np.ndarray, table: np.ndarray, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE, mask: int = SPLIT_MASK) -> list[int]:
    """Ends of the chunks of one stream; the last is its length. Below the minimum a split is passed over; at the maximum a chunk ends.

    Bytes whose whole window lies below the minimum need no hash; the hash isn't reset at a split, so the points depend on the window only."""
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    n, out, start = len(data), [], 0
    step = 1 << 22
    cuts: list[np.ndarray] = []
    for a in range(0, n, step):
        lead = min(a, WINDOW)
        h = window_hash(data[a - lead : a + step], table)[lead:]
        cuts.append(np.flatnonzero((h & np.uint32(mask)) == 0) + a + 1)
    ends = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    while start < n:
        k = int(np.searchsorted(ends, start + min_size))
        end = int(ends[k]) if k < len(ends) else n
        start = min(end, start + max_size, n)
        out.append(start)
    return out


def chunk_stream(data: bytes, table: np.ndarray, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE, mask: int = SPLIT_MASK) -> list[bytes]:
    """The chunks of a stream; an empty stream is one empty chunk."""
    ends = split_points(data, table, min_size, max_size, mask) or [0]
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def address_of(data: bytes, key: bytes = b"") -> str:
    return hashlib.sha256(key + data).hexdigest()


def chunk_streams(streams: DataFrame, seed: bytes = b"sediment", key: bytes = b"", min_size: int = MIN_SIZE, max_size: int = MAX_SIZE, mask: int = SPLIT_MASK) -> DataFrame:
    """(stream_id, pos, address, data, n_bytes) of streams (stream_id string, data binary). Null data is an empty stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table(seed)
        for batch in batches:
            for sid, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = chunk_stream(data.as_py() or b"", table, min_size, max_size, mask)
                yield pa.RecordBatch.from_arrays([pa.array([sid] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array([address_of(p, key) for p in parts]), pa.array(parts, pa.binary()), pa.array([len(p) for p in parts], pa.int64())], names=["stream_id", "pos", "address", "data", "n_bytes"])

    return streams.select(F.col("stream_id").cast("string"), F.col("data").cast("binary")).mapInArrow(run, "stream_id string, pos long, address string, data binary, n_bytes long")


# Compression: a footer byte names the codec (fixed values), lz4 also keeps the size before it.
NONE, LZ4, ZSTD = 0, 1, 2
MAX_PLAIN = 64 << 20


def parse_compression(spec: str = "zstd:3") -> tuple[str, int]:
    """`none`, `lz4` or `zstd[:level]` as (codec, level)."""
    name, _, level = spec.partition(":")
    if name in ("none", "lz4") and not level:
        return name, 0
    if name == "zstd" and (not level or level.isdigit() and 1 <= int(level) <= 19):
        return name, int(level or 3)
    raise ValueError(f"invalid compression {spec!r}")


def compress_bytes(data: bytes, spec: str = "zstd:3") -> bytes:
    """The data and its footer; stored plainly where compression doesn't help."""
    codec, level = parse_compression(spec)
    if codec == "lz4":
        packed = pa.compress(data, "lz4_raw", asbytes=True) + len(data).to_bytes(4, "little") + bytes([LZ4])
    elif codec == "zstd":
        import zstandard

        packed = zstandard.ZstdCompressor(level).compress(data) + bytes([ZSTD])
    else:
        packed = data + bytes([NONE])
    return packed if len(packed) <= len(data) else data + bytes([NONE])


def decompress_bytes(packed: bytes) -> bytes:
    if not packed:
        raise ValueError("no compression footer")
    body, codec = packed[:-1], packed[-1]
    if codec == NONE:
        return body
    if codec == LZ4:
        size = int.from_bytes(body[-4:], "little")
        if size > MAX_PLAIN:
            raise ValueError("decompressed chunk is too large")
        return pa.decompress(body[:-4], size, "lz4_raw", asbytes=True)
    if codec == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(body, max_output_size=MAX_PLAIN)
    raise ValueError(f"unknown compression {codec}")


def _mapped(function, column: Column, kind: T.DataType = T.BinaryType()) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else function(v) for v in values.to_pylist()], pa.binary())

    return run(column)


def compress(column: Column, spec: str = "zstd:3") -> Column:
    parse_compression(spec)
    return _mapped(lambda v: compress_bytes(v, spec), column)


def decompress(column: Column) -> Column:
    return _mapped(decompress_bytes, column)


def encrypt(column: Column, key: Column) -> Column:
    """AES-GCM with a random nonce; the key has 16, 24 or 32 bytes."""
    return F.aes_encrypt(column, key, F.lit("GCM"))


def decrypt(column: Column, key: Column) -> Column:
    """Null where the key is wrong or the data was changed."""
    return F.try_aes_decrypt(column, key, F.lit("GCM"))


def pack(column: Column, spec: str = "zstd:3", key: bytes = b"") -> Column:
    """Data as a store keeps them: compressed, and encrypted where there is a key."""
    packed = compress(column, spec)
    return encrypt(packed, F.lit(key)) if key else packed


def _decompress_or_none(packed: bytes) -> bytes | None:
    import zstandard

    try:
        return decompress_bytes(packed)
    except (ValueError, OSError, zstandard.ZstdError):
        return None


def unpack(column: Column, key: bytes = b"") -> Column:
    """What `pack` was given; null where the key is wrong or the data were changed so that they can't be read."""
    return _mapped(_decompress_or_none, decrypt(column, F.lit(key)) if key else column)


# Set operations of a store.


def missing(addresses: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct addresses that aren't stored."""
    return addresses.select("address").distinct().join(stored.select("address"), "address", "left_anti")


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """One of each chunk that isn't stored; a stored one is never replaced. Addresses are compared first, so data of stored chunks don't move."""
    return chunks.join(missing(chunks, stored), "address", "left_semi").dropDuplicates(["address"])


def flush_stats(added: DataFrame) -> DataFrame:
    return added.agg(F.count("*").alias("added_chunks"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("added_bytes"))


def sweep_stats(stored: DataFrame, reachable: DataFrame) -> DataFrame:
    """One row: chunks and bytes deleted and remaining."""
    marks = reachable.select("address").distinct().withColumn("kept", F.lit(True))
    both = stored.select("address", "n_bytes").join(marks, "address", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    total = lambda keep: F.coalesce(F.sum(F.when(F.col("kept") == keep, F.col("n_bytes"))), F.lit(0))
    return both.agg(F.count_if(~F.col("kept")).alias("chunks_deleted"), total(False).alias("bytes_deleted"), F.count_if(F.col("kept")).alias("chunks_remaining"), total(True).alias("bytes_remaining"))


def fetch(addresses: DataFrame, stored: DataFrame) -> DataFrame:
    """Data for (pos, address), in order of pos; data is null where the store lacks it."""
    return addresses.join(stored, "address", "left").orderBy("pos")
