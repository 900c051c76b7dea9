import functools
import os
import random
import stat

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment import schemas
from sediment.functions import globs, scalars
from sediment.operators import bloom, chunks, htree, index, oplog, sendlog


def test_path_order(spark):
    """Random paths against a comparison of two paths at a time: the root, then at each level names that end there, then those that go on, by bytes."""
    rng = random.Random(7)
    paths = [".", *{"/".join(rng.choice(["k", "mm", "Q", "é", "z9", "_"]) for _ in range(rng.randint(1, 4))) for _ in range(60)}]

    def before(a, b):
        if "." in (a, b):
            return a == "."
        while True:
            (x, _, more_a), (y, _, more_b) = a.partition("/"), b.partition("/")
            if bool(more_a) != bool(more_b):
                return not more_a
            if x != y or not more_a:
                return x.encode() < y.encode()
            a, b = more_a, more_b

    want = sorted(paths, key=functools.cmp_to_key(lambda a, b: -1 if before(a, b) else 1))
    rng.shuffle(paths)
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in index.in_listing_order(df).collect()] == want


@pytest.mark.parametrize(("n", "text"), [(0, "0B"), (1024, "1024B"), (1025, "1.00KiB"), (2047, "1.102KiB"), (1 << 20, "1024.00KiB"), (3 << 30, "3.00GiB"), ((1 << 50) + 1, "1.00PiB")])
def test_format_size(spark, n, text):
    assert spark.range(1).select(scalars.format_size(F.lit(n).cast("long"))).first()[0] == text


def test_mode_strings(spark):
    modes = [0o100644, 0o040755, 0o120777, 0o104755, 0o102644, 0o041777, 0o041776, 0o010600, 0o140000]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in modes], "m long").select(scalars.display_mode(F.col("m"))).collect()]
    assert got == [stat.filemode(m) if m != 0o140000 else "?---------" for m in modes]


def test_oplog_closed_form(spark):
    rng = random.Random(3)
    log, live, removed, added = [], {}, {}, []
    for k in range(400):
        kind = rng.choice("aaarrx" if k % 9 else "R")
        if kind == "a":
            log.append((k, schemas.ADD, f"i{k}", None))
            live[f"i{k}"] = k
            added.append(f"i{k}")
        elif kind == "r" and added:
            ids = [rng.choice(added), "unknown"]
            log.append((k, schemas.REMOVE, None, ids))
            removed.update({i: live.pop(i) for i in ids if i in live})
        elif kind == "R":
            log.append((k, schemas.RECOVER, None, None))
            live.update(removed)
            removed = {}
    df = spark.createDataFrame(log, "log_offset long, op string, item_id string, removed_ids array<string>")
    assert {r.item_id: r.added_at for r in oplog.live_items(df).collect()} == live
    assert {r.item_id for r in oplog.removed_items(df).collect()} == set(removed)
    kept = oplog.compact(df, oplog.live_items(df))
    assert kept.count() == len(live) and oplog.next_offset(df) == log[-1][0] + 1
    assert oplog.tail(df, 100, 200).agg(F.min("log_offset"), F.max("log_offset")).first()[0] > 100


def _entries(spark, rows):
    return spark.createDataFrame(rows, "path string, size long, data_hash string, mode long, mtime long, mtime_nsec long")


def test_diff_masks(spark):
    a = _entries(spark, [("x", 1, "h", 0o100644, 1, 0), ("y", 1, None, 0o100644, 1, 0), ("z", 2, "k", 0o100644, 1, 5)])
    b = _entries(spark, [("x", 1, "h", 0o100644, 2, 0), ("y", 1, None, 0o100644, 1, 0), ("z", 2, "m", 0o100644, 1, 5), ("w", 0, None, 0o040755, 1, 0)])
    got = lambda ignore: sorted((r.path, r.op) for r in index.diff(a, b, ignore).collect())
    assert got(index.ignored()) == [("w", "+"), ("x", "+"), ("x", "-"), ("z", "+"), ("z", "-")]
    assert got(index.ignored(relaxed=True)) == [("w", "+"), ("z", "+"), ("z", "-")]
    assert got(index.ignored("content,times")) == got(index.ignored("file-content,times")) == [("w", "+")]
    with pytest.raises(ValueError):
        index.ignored("nothing")
    assert sorted((r.action, r.path) for r in index.restore_plan(a, b).collect()) == [("delete", "z"), ("download", "z"), ("mkdir", "w")]


def test_data_map_equals_replay(spark):
    """Ranges and partial chunks against the bytes that each entry covers."""
    rng = random.Random(5)
    for size in (7, 16):
        at, rows, want = 0, [], {}
        for k in range(60):
            n = rng.choice([0, 1, 3, size, 2 * size, 17])
            rows.append((k, n, ((at + n) // size - at // size, at % size, (at + n) % size)))
            if k % 3:
                for byte in range(at, at + n):
                    want.setdefault(byte // size, set()).add(byte % size)
            at += n
        df = spark.createDataFrame(rows, "seq long, size long, data_cursor struct<chunk_delta: long, start_byte_offset: long, end_byte_offset: long>").withColumn("g", F.lit(1))
        ranges = index.chunk_ranges(df, "g", selected=F.expr("seq % 3 <> 0")).collect()
        assert {i for r in ranges for i in range(r.start_idx, r.end_idx + 1)} == set(want)
        parts = {}
        for r in index.partial_chunks(df, "g", selected=F.expr("seq % 3 <> 0")).collect():
            parts.setdefault(r.chunk_idx, set()).update(range(r.start, size if r.stop is None else r.stop))
        for idx, own in want.items():
            assert parts.get(idx, set(range(size))) == own


def test_hard_links_and_devices(spark):
    df = spark.createDataFrame([(0, "a", 5, 1, 2, 0o100644), (1, "b", 5, 1, 2, 0o100644), (2, "c", 3, 1, 2, 0o100644), (3, "d", 5, 1, 2, 0o040755)], "seq long, path string, dev long, ino long, nlink long, mode long")
    normal = index.normalized_devices(df)
    assert {r.path: r.norm_dev for r in normal.collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}
    assert {r.path: r.first_path for r in index.hard_links(normal).collect()} == {"a": None, "b": "a", "c": None, "d": None}


def test_pick(spark):
    df = spark.createDataFrame([(p, m) for p, m in ((".", 16877), ("bar", 16877), ("bar/baz", 16877), ("bar/baz/a.txt", 33188), ("bang", 33188), ("barn", 33188))], "path string, mode long")
    assert {r.path for r in index.pick(df, "bar/").collect()} == {".", "baz", "baz/a.txt"}
    assert index.pick(df, ".").count() == 6
    assert index.picked_kind(df, "bang") == "regular"
    with pytest.raises(LookupError):
        index.picked_kind(df, "no")


def test_exclusions(spark):
    paths = ["/t/foo", "/t/foo/bang", "/t/foo/bar", "/t/foo/bar/bang", "/t/foo/bar/baz", "/t/foo/bar/baz/bang"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for pattern, n in (("**/bang", 3), ("bang", 3), ("/t/foo/*/bang", 5), ("/*/bang", 6), ("bar", 2)):
        assert index.exclude(df, [globs.exclusion(pattern)]).count() == n, pattern
    marked = spark.createDataFrame([(p,) for p in ("f", "f/bang", "f/bar", "f/bar/bang", "f/bar/.skip", "f/bar/baz", "f/bar/baz/bang")], "path string")
    assert {r.path for r in index.exclude_marked(marked, [".skip"]).collect()} == {"f", "f/bang", "f/bar", "f/bar/.skip"}


def _sequential_splits(data, table, low, high, mask):
    lanes, at, out, size = [0] * 8, 0, [], 0
    for b in data:
        lanes[at] = ((lanes[at] << 1) + int(table[b])) & 0xFFFFFFFF
        size += 1
        if (lanes[at] & mask == 0 and size >= low) or size == high:
            out.append(size)
            size = 0
        at = (at + 1) % 8
    return out + [size] * (size > 0)


@pytest.mark.parametrize("n", [0, 1, 255, 257, 20_000])
def test_chunking_equals_the_sequential_hash(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    table = chunks.gear_table(b"x")
    got = [len(c) for c in chunks.chunk_stream(data, table, 64, 900, 0xFF000000)]
    assert got == (_sequential_splits(data, table, 64, 900, 0xFF000000) or [0])


def test_chunk_store(spark):
    streams = spark.createDataFrame([("a", bytearray(b"x" * 3000)), ("b", bytearray(b"x" * 3000)), ("c", None)], "stream_id string, data binary")
    found = chunks.chunk_streams(streams, min_size=64, max_size=1000).cache()
    assert b"".join(bytes(r.data) for r in found.where("stream_id = 'a'").orderBy("pos").collect()) == b"x" * 3000
    assert found.where("stream_id = 'c'").first().n_bytes == 0
    fresh = chunks.new_chunks(found, found.where("stream_id = 'c'"))
    assert chunks.flush_stats(fresh).first().added_chunks == 1
    assert chunks.missing(found, fresh).count() == 1
    assert chunks.sweep_stats(fresh, fresh.limit(0)).first().chunks_deleted == 1


@pytest.mark.parametrize("spec", ["none", "lz4", "zstd", "zstd:19"])
def test_compression(spec):
    for data in (b"", b"abc", b"abc" * 1000, os.urandom(100)):
        packed = chunks.compress_bytes(data, spec)
        assert chunks.decompress_bytes(packed) == data and len(packed) <= len(data) + 1
    for bad in ("zstd:20", "gzip", "lz4:1"):
        with pytest.raises(ValueError):
            chunks.parse_compression(bad)


def _address(k):
    return chunks.address_of(str(k).encode())


@pytest.mark.parametrize(("n", "total"), [(1, 1), (2, 3), (3, 6)])
def test_tree_shapes(n, total):
    b = htree.TreeBuilder(htree.MIN_NODE, htree.MIN_NODE)
    for k in range(n):
        b.add(_address(k))
    root, height, leaves, count = b.finish()
    assert (leaves, count) == (n, total)
    assert (n > 1) or (root == _address(0) and height == 0)


def test_tree_walk_and_ranges(spark):
    rows = [("t", k, _address(k)) for k in range(50)] + [("u", k, _address(k)) for k in range(50)] + [("one", 0, _address(0))]
    edges = htree.build(spark.createDataFrame(rows, "tree_id string, pos long, address string"), htree.MIN_NODE, 160).cache()
    tops, nodes = htree.roots(edges), htree.nodes(edges)
    assert tops.select("root").distinct().count() == 2
    assert [r.address for r in htree.leaf_positions(tops.where("tree_id = 't'"), nodes).orderBy("idx").collect()] == [_address(k) for k in range(50)]
    spans = spark.createDataFrame([("t", 3, 4), ("t", 40, 45)], "tree_id string, start_idx long, end_idx long")
    assert sorted(r.idx for r in htree.leaf_positions(tops, nodes, spans).collect()) == [3, 4, *range(40, 46)]
    assert htree.reachable(tops, nodes).count() == 50 + nodes.select("parent").distinct().count()
    assert htree.verify(nodes).isEmpty()
    assert not htree.verify(nodes.withColumn("leaf_count", F.col("leaf_count") + 1)).isEmpty()


def test_bloom(spark):
    own = [_address(k) for k in range(5000)]
    df = spark.createDataFrame([(a,) for a in own], "address string")
    bits = bloom.build(df, bloom.size_for(0.05, 5000))
    assert df.where(~bloom.probe(bits, F.col("address"))).isEmpty()
    assert abs(bloom.false_positives(bits) - 0.05) < 0.02 and abs(bloom.estimated_count(bits) - 5000) < 250


def test_send_log(spark):
    log = spark.createDataFrame([("a", "g1", "s1", "i1"), ("b", "g0", "s1", "i1"), ("c", "g0", "s1", None), ("d", "g0", "s0", "i0")], "address string, gc_generation string, latest_session_id string, item_id string")
    names = lambda df: sorted(r.address for r in df.collect())
    assert names(sendlog.invalidate(log, "g1", None)) == ["a"]
    assert names(sendlog.invalidate(log, "g1", "i1")) == ["a", "b"]
    seen = spark.createDataFrame([("a",), ("z",), ("z",)], "address string")
    touched = sendlog.touch(log, seen, "address", "g2", "s9")
    assert names(touched) == ["a", "b", "c", "d", "z"]
    assert names(sendlog.commit(touched, "s9", "new")) == ["a", "z"]
    assert names(sendlog.unsent(seen.distinct(), log)) == ["z"]


def test_hex_keys_and_zeros(spark):
    import hashlib

    row = spark.createDataFrame([("aBcD", b"one", b"two", bytes(5), b"\0\1", b"")], "h string, a binary, b binary, z binary, y binary, e binary").select(
        scalars.from_hex(F.col("h")), scalars.derived_key(F.col("a"), F.col("b")), scalars.all_zeros(F.col("z")), scalars.all_zeros(F.col("y")), scalars.all_zeros(F.col("e"))
    ).first()
    assert (bytes(row[0]), bytes(row[1]), *row[2:]) == (b"\xab\xcd", hashlib.sha256(b"onetwo").digest(), True, False, True)
