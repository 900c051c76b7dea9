"""Bloom filters over addresses: the four 8-byte slices of an address are its hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 4
#: Bounds of a filter's size in bytes, and the false positives aimed at.
MIN_BYTES, MAX_BYTES, TARGET = 128 * 1024, (4 << 30) - 1, 0.02


def size_for(rate: float, count: int) -> int:
    """Bytes that keep the false positives of `count` addresses below `rate`."""
    return int(-SLICES * count / math.log(1 - rate ** (1 / SLICES)) / 8)


def gc_size(count: int) -> int:
    return min(max(size_for(TARGET, count), MIN_BYTES), MAX_BYTES)


#: Bytes of a filter that every task may hold.
MAX_BROADCAST = 256 << 20


def positions(addresses: np.ndarray, n_bits: int) -> np.ndarray:
    """Bit places of addresses given as an (n, 32) byte array."""
    return addresses.reshape(-1, SLICES, 8).copy().view("<u8")[:, :, 0] % np.uint64(n_bits)


def _bytes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint8).reshape(-1, 32)


def build(addresses: DataFrame, n_bytes: int, pieces: int = 64) -> bytes:
    """The filter of (address): each task fills its own, which are then united in pieces by a second stage."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bytes, np.uint8)
        for batch in batches:
            if len(batch):
                at = positions(_bytes_of(batch.column(0)), n_bytes * 8).ravel()
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for k, part in enumerate(np.array_split(bits, pieces)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(b, np.uint8)
                own[k] = own[k] | part if k in own else part
        for k, part in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "bits"])

    rows = addresses.where("address IS NOT NULL").select("address").mapInArrow(fill, "k int, bits binary").repartition(pieces, "k").mapInArrow(unite, "k int, bits binary").collect()
    out = np.zeros(n_bytes, np.uint8)
    parts = np.array_split(out, pieces)
    for r in rows:
        parts[r.k][:] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def probe(bits: bytes, address: Column) -> Column:
    """If the filter may hold an address; never false for one it was built from. A filter of more than MAX_BROADCAST bytes isn't sent to tasks: an anti-join of addresses does its work then."""
    if len(bits) > MAX_BROADCAST:
        raise ValueError(f"a filter of {len(bits)} bytes is too large to broadcast")
    from pyspark.sql import SparkSession
    from pyspark.sql.functions import arrow_udf

    sent = SparkSession.active().sparkContext.broadcast(bits)

    @arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        own = np.frombuffer(sent.value, np.uint8)
        if not len(column):
            return pa.array([], pa.bool_())
        at = positions(_bytes_of(column.fill_null("00" * 32)), len(own) * 8)
        return pa.array(((own[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1))

    return F.coalesce(run(address), F.lit(False))


def utilization(bits: bytes) -> float:
    return int(np.bitwise_count(np.frombuffer(bits, np.uint8)).sum()) / (len(bits) * 8)


def estimated_count(bits: bytes) -> float:
    """Addresses that were added, from the bits that are set."""
    return -(len(bits) * 8) / SLICES * math.log(1 - utilization(bits)) if utilization(bits) < 1 else math.inf


def false_positives(bits: bytes, trials: int = 10_000, seed: int = 0) -> float:
    own = np.frombuffer(bits, np.uint8)
    at = positions(np.random.default_rng(seed).integers(0, 256, (trials, 32), dtype=np.uint8), len(own) * 8)
    return float(((own[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1).mean())
