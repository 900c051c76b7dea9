"""Shared helpers: inputs, shared storage, byte-level word kernels and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0x20 and 0x09-0x0D separate words; every other byte belongs to a word.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text that a kernel works on at a time (a longer text is taken whole): its arrays take some forty times as much.
SLICE_BYTES = 1 << 18
#: Arrow batches, which JVM and Python hold at once: texts may be long.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(df: DataFrame, *columns: Column) -> DataFrame:
    """The columns that a Python kernel reads, in Arrow batches of bounded size unless the session sets its own."""
    for key, value in BATCH_LIMITS.items():
        if df.sparkSession.conf.get(key, None) is None:
            df.sparkSession.conf.set(key, value)
    return df.select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary folder is set, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sediment-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sediment-{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it again, so that lineage ends there and no step runs twice."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            p = np.full(max(n, SLICE_BYTES * 2), base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["p"], _POWERS["i"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes each; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in `raw`, and for each row the index of its first word (one more entry ends the last)."""
    if not len(raw):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = is_word[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, with A-Z lower-cased if `lower`; equal words have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[LOWER[raw] if lower else raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word shingles, and the index of each row's first one; a row with fewer words has its whole sequence as one."""
    counts = np.diff(first)
    n_out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n_out, out=at[1:])
    factors = np.random.default_rng(7).integers(1, 2**63, width, dtype=np.uint64) | np.uint64(1)
    if not len(words):
        return np.zeros(0, np.uint64), at
    # The j-th word of a shingle that starts at i; shingles that would cross a row are left out by `index`.
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    whole = sum(padded[j : j + len(words)] * factors[j] for j in range(width))
    index = np.arange(at[-1]) - np.repeat(at[:-1], n_out) + np.repeat(first[:-1], n_out)
    out = whole[index]
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[row] : first[row + 1]]
        out[at[row]] = (np.append(own, np.uint64(len(own))) * np.append(factors[: len(own)], np.uint64(0xD6E8FEB86659FD93))).sum(dtype=np.uint64)
    return mix(out), at


def distinct_shingles(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes."""
    starts, ends, first = word_spans(raw, offsets)
    shingles, at = shingle_hashes(word_hashes(raw, starts, ends), first, width)
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = np.sort(shingles[a:b])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        yield own


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars, as joins and minima only.

    Returns (id, component): each id of an edge with the smallest id it reaches. Edges with nulls
    are ignored, repeated ones and loops do no harm; without edges the result is empty.
    Each round is written to the shared folder, so lineage stays short; the round before it is deleted.
    """
    e = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    sign = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
