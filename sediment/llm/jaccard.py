"""N-gram Jaccard join: a parity-sketch join, and its components.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. Each hash flips one bit of a
sketch, so the Hamming distance of two sketches is at most the size of the sets' symmetric difference.
For a Jaccard similarity of at least 0.8 that difference is at most (a + b) / 9, so a sketch that is
cut into m blocks has at least m - (a + b) / 9 blocks in which two linked sets agree (pigeonhole).
Blocks are compared by one 64-bit digest of their set bits (the XOR of the bits' hashes). A sketch of
SKETCH bits is kept for each set, and pairs whose distance in it is too large are dropped before sets are read.

Size bands: m must be the same for both documents. A pair whose sizes are in one band [u/2, u) meets
there, with at most 2u/9 differences; a pair on both sides of a boundary u meets in the straddling
band of u, with at most u/4. Every document is in its band, and in a straddling band if its size is
within a factor of 1.25 of a boundary.

Blocks with less than two set bits say little and are left out, but for a set with so many of them
that no others might agree with a linked set (its linked sets then keep theirs too).

Buckets: documents with one set count once (a class). Buckets of up to SMALL classes give all their
pairs. Larger, hot ones matter only for classes whose agreeing blocks may all be hot or left out (bound
classes); any other class meets each of its links in a small bucket. Bound classes are joined among
themselves on their rarest shingles: two linked sets share one of the n - ceil(0.8 n) + 1 that fewest
bound classes hold, and what is rarer there bounds what they can have in common.

What is still hot (groups of thousands of near copies) isn't expanded into pairs. All members of a bucket
are measured against its most typical one; only members of different components are looked at after that, one
of them must hold nearly all of its set at or behind the bucket's shingle, and their distances from the typical
one (1 - similarity is a metric) must differ by no more than that of a link. So every link between documents of
different components is found and the components are exact.

Counting links: a pair that may not have been verified by then has both its classes in hot buckets, and lies in one
component. The classes of a component that are in hot buckets are cut into blocks of bounded size, and each two
blocks are one task's work: all common hashes as a product of matrices, of which only the links of each class leave.
All other links were verified before. So n_links is exact, and rows stay linear in the classes of a block.

Hot keys: a key that more than SMALL classes of one task share is hot already; its members then go to tasks by
their own hash, and its home only gets a marker. Homes read their parts in bounded pieces.

Verification counts common hashes exactly. Nothing is capped or dropped.

Defined results: null texts and texts without words have an empty set and link with nothing; copies
share a component, and count among each other's links; repeated rows of one doc_id stay as rows; rows with a null doc_id are left out,
for they can't name a component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, distinct_shingles, materialize, mix, shuffle_partitions, slices, table, text_buffers, texts_of

SMALL = 8
#: Bits of the sketch that is kept, in words of 64.
SKETCH = 256
SKETCHED = [f"s{k}" for k in range(SKETCH // 64)]
#: Keys that a task holds before it deals them out, bytes of text for each part of the keys, and bytes of a part read at once.
BUFFER_KEYS, PART_TEXT, PIECE_BYTES = 1 << 19, 8 << 20, 24 << 20
#: Bits of the filter for wanted sets: 16 for each set, within these bounds (16 MB at most); beyond, more sets pass it in vain.
LEAST_BLOOM, MOST_BLOOM = 1 << 20, 1 << 27
STAGED = "kind int, a long, b long, c long, d long, " + ", ".join(f"{s} long" for s in SKETCHED)
#: A block of a component, when links are counted: hashes and classes it holds on average, and columns of a matrix at once.
BLOCK_HASHES, BLOCK_CLASSES, COLUMNS = 1 << 21, 1 << 10, 1 << 12
DEALT = "part int, kind int, body binary"


def blocks_of(limit: int, most: int, share: float) -> int:
    """Blocks for sizes up to `limit` and `most` differences: more for small sets, whose signatures cost little."""
    return max(most + 1, int(np.ceil(limit * (1.0 if limit <= 128 else max(share, 0.4) if limit <= 512 else share))) + 2)


def bands(n: int) -> list[tuple[int, int, int]]:
    """(band id, blocks, most differences) for a set of n > 0 shingles."""
    k = int(n).bit_length()
    upper = 1 << k
    out = [(2 * k, blocks_of(upper, 2 * upper // 9, 0.3), 2 * upper // 9)]
    for boundary in (upper >> 1, upper):
        if boundary > 1 and 4 * boundary <= 5 * n and 4 * n <= 5 * boundary:
            out.append((2 * (boundary.bit_length() - 1) + 1, blocks_of(boundary, boundary // 4, 0.33), boundary // 4))
    return out


def signatures(hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """For each band (band id, keys of the blocks kept, blocks left out, blocks that must agree with a linked set's)."""
    bits = mix(hashes ^ np.uint64(0x5BD1E995))
    for band, m, most in bands(len(hashes)):
        most = min(most, len(hashes) // 4)  # a partner has at most 5/4 times the size
        block = (hashes % np.uint64(m)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.diff(block[order], prepend=-1))
        size = np.diff(np.append(cut, len(order)))
        keys = mix(np.bitwise_xor.reduceat(bits[order], cut) ^ mix((block[order][cut].astype(np.uint64) << np.uint64(8)) + np.uint64(band)))
        spare = m - most
        if m - int((size > 1).sum()) < spare:
            keys = keys[size > 1]
        elif len(cut) <= most:  # even empty blocks may be all that agree: these sets meet under one more key
            keys = np.append(keys, mix(np.array([~np.uint64(band)], np.uint64)))
        yield band, keys, m - len(keys), spare


def class_of(hashes: np.ndarray) -> int:
    """A 64-bit name of the set, as a signed number; 0 is the empty set."""
    if not len(hashes):
        return 0
    h = mix(np.array([hashes.sum(dtype=np.uint64) ^ mix(np.bitwise_xor.reduce(mix(hashes)).reshape(1))[0]], np.uint64) + np.uint64(len(hashes)))
    return int(h.view(np.int64)[0]) or 1


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and sets, about a megabyte of text at a time."""
    for batch in batches:
        raw, at = text_buffers(batch.column(1))
        ids = batch.column(0).to_pylist()
        for i, j in slices(at):
            yield ids[i:j], list(distinct_shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i]))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as signed words of 64 bits."""
    odd = np.bincount((hashes >> np.uint64(17)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def deal(out: list[tuple[int, int, bytes]], kind: int, part: np.ndarray, rows: np.ndarray) -> None:
    """Adds (part, kind, body) rows: the rows of each part, as bytes."""
    if not len(rows):
        return
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        out.append((int(part[order[a]]), kind, rows[order[a:b]].tobytes()))


def deal_keys(out: list[tuple[int, int, bytes]], key: np.ndarray, owner: np.ndarray, parts: int) -> None:
    """Kind 1 (key, class) for the key's part. Of keys that are hot here: kind 3 (key, class) for a part of its own, and kind 4 (key) for the key's part."""
    order = np.argsort(key.view(np.uint64))
    key, owner = key[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cut, len(key)))
    hot = np.repeat(size > SMALL, size)
    deal(out, 1, part_of(key[~hot], parts), np.stack([key[~hot], owner[~hot]], 1))
    if hot.any():
        rows = np.stack([key[hot], owner[hot]], 1)
        deal(out, 3, part_of(mix((rows[:, 0] ^ rows[:, 1]).view(np.uint64)).view(np.int64), parts), rows)
        deal(out, 4, part_of(key[cut[size > SMALL]], parts), key[cut[size > SMALL]])


def dealt_batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["part", "kind", "body"])


def n_parts(docs: DataFrame, per: int = PART_TEXT) -> int:
    """Parts for the keys of these texts: a multiple of the shuffle's partitions, so that no part gets much more than `per` bytes of text."""
    tasks = shuffle_partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return tasks * max(1, -(-size // (tasks * per)))


def to_parts(dealt: DataFrame) -> DataFrame:
    """Rows with a column `part`: the parts are dealt evenly, and come one after the other in a task."""
    tasks = shuffle_partitions(dealt.sparkSession)
    return dealt.repartitionById(tasks, F.expr(f"part % {tasks}")).sortWithinPartitions("part")


def _emit(parts: int):
    """Rows (part, kind, body): kind 0 holds (class, doc_id, size, sketch), kinds 1, 3 and 4 keys, kind 2 (class, band, blocks left out, blocks that must agree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, free, about, seen, held = [], [], [], [], set(), 0

        def flush() -> pa.RecordBatch:
            out: list[tuple[int, int, bytes]] = []
            rows = np.array(about, np.int64).reshape(-1, 3 + len(SKETCHED))
            deal(out, 0, part_of(mix(rows[:, 1].astype(np.uint64)).view(np.int64), parts), rows)
            if keys:
                deal_keys(out, np.concatenate(keys).view(np.int64), np.concatenate(owners), parts)
                rows = np.array(free, np.int64)
                deal(out, 2, part_of(mix(rows[:, 0].astype(np.uint64)).view(np.int64), parts), rows)
            for x in (keys, owners, free, about, seen):
                x.clear()
            return dealt_batch(out)

        for ids, sets in _documents(batches):
            for doc, own in zip(ids, sets, strict=True):
                name = class_of(own)
                about.append((name, doc, len(own), *sketch(own).tolist()))
                if name and name not in seen:
                    seen.add(name)
                    for band, key, empty, agree in signatures(own):
                        keys.append(key)
                        owners.append(np.full(len(key), name, np.int64))
                        free.append((name, band, empty, agree))
                        held += len(key)
            if held >= BUFFER_KEYS or len(about) >= BUFFER_KEYS >> 4:
                yield flush()
                held = 0
        if about:
            yield flush()

    return run


def _rows(kind: int, *columns) -> Iterator[pa.RecordBatch]:
    names = ["kind", "a", "b", "c", "d", *SKETCHED]
    for at in range(0, len(columns[0]), 1 << 16):
        own = [pa.array(np.ascontiguousarray(c[at : at + (1 << 16)], dtype=np.int64)) for c in columns]
        n = len(own[0])
        where = (3 if kind == 0 else 4) + 1  # the sketch stands behind d
        own = own[: where - 1] + [pa.nulls(n, pa.int64())] * (len(names) - 1 - len(own)) + own[where - 1 :]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *own], names=names)


def _sorted_unique(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[new]


def _bucket_part(pieces: Iterator[dict[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
    """One part, piece by piece. Between pieces it keeps hot keys, and of other keys at most SMALL members each."""
    width = 3 + len(SKETCHED)
    pairs, hot = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    for bodies in pieces:
        yield from _rows(0, *np.frombuffer(b"".join(bodies[0]), np.int64).reshape(-1, width).T)
        if bodies[2]:
            yield from _rows(3, *_sorted_unique(np.frombuffer(b"".join(bodies[2]), np.int64).reshape(-1, 4)).T)
        if bodies[3]:
            yield from _rows(2, *_sorted_unique(np.frombuffer(b"".join(bodies[3]), np.int64).reshape(-1, 2)).T)
        if bodies[4]:
            hot = np.union1d(hot, np.frombuffer(b"".join(bodies[4]), np.int64))
        if bodies[1]:
            pairs = _sorted_unique(np.concatenate([pairs, np.frombuffer(b"".join(bodies[1]), np.int64).reshape(-1, 2)]))
        if len(pairs):
            cut = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]]))
            size = np.diff(np.append(cut, len(pairs)))
            own = (size > SMALL) | np.isin(pairs[cut, 0], hot)
            hot = np.union1d(hot, pairs[cut[own], 0])
            own = np.repeat(own, size)
            yield from _rows(2, *pairs[own].T)
            pairs = pairs[~own]
    found = [np.zeros((0, 2), np.int64)]
    for step in range(1, SMALL):
        i = np.flatnonzero(pairs[step:, 0] == pairs[:-step, 0])
        if not len(i):
            break
        found.append(np.stack([pairs[i, 1], pairs[i + step, 1]], 1))
    yield from _rows(1, *_sorted_unique(np.concatenate(found)).T)


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From bodies sorted by part: kind 0 (class, doc, size, sketch), 1 (class, class) of small buckets, 2 (key, class) of hot ones, 3 (class, band, left out, agreeing)."""

    def pieces() -> Iterator[tuple[int, dict[int, list[bytes]]]]:
        part, size, bodies = None, 0, {k: [] for k in range(5)}
        for batch in batches:
            for p, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size and (p != part or size >= PIECE_BYTES):
                    yield part, bodies
                    size, bodies = 0, {k: [] for k in range(5)}
                part = p
                bodies[kind].append(body)
                size += len(body)
        if size:
            yield part, bodies

    for _, own in groupby(pieces(), lambda x: x[0]):
        yield from _bucket_part(bodies for _, bodies in own)


def wanted_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter over (class, rep), which goes to the tasks that read the texts, so that few other sets leave them."""
    n = wanted.count()
    size = min(MOST_BLOOM, max(LEAST_BLOOM, 1 << (16 * n).bit_length()))
    bit = F.pmod(F.col("class").bitwiseXOR(F.shiftleft("rep", 23)).bitwiseXOR(F.shiftrightunsigned("rep", 17)), F.lit(size))
    maps = wanted.select(bit.alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("chunk")).agg(F.bitmap_construct_agg((F.col("bit") % 32768).cast("int")).alias("bits"))
    bloom = np.zeros(size // 8, np.uint8)
    for row in maps.collect():  # at most as many bytes as MOST_BLOOM / 8
        bloom[row.chunk * 4096 : (row.chunk + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return bloom


def is_wanted(bloom: np.ndarray, name: int, doc: int) -> bool:
    at = (name ^ (doc << 23) ^ ((doc & 0xFFFFFFFFFFFFFFFF) >> 17)) & (8 * len(bloom) - 1)
    return bool(bloom[at >> 3] >> (at & 7) & 1)


def set_batch(out: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    at = np.zeros(len(out) + 1, np.int32)
    np.cumsum([len(x[2]) for x in out], out=at[1:])
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([x[2] for x in out]).view(np.int64)))], names=["class", "rep", "hashes"])


SET_SCHEMA = "class long, rep long, hashes array<long>"


def document_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, rep, hashes) of the classes asked for, each from its document `rep`; others that the filter lets through don't join anything later."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = sent.value
        for ids, sets in _documents(batches):
            out = [(name, doc, own) for doc, own in zip(ids, sets, strict=True) if (name := class_of(own)) and is_wanted(bloom, name, doc)]
            if out:
                yield set_batch(out)

    return docs.mapInArrow(run, SET_SCHEMA)


def measured(pairs: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = 80) -> DataFrame:
    """(a, b, common, total) of pairs (a, b) of classes: common hashes, by counting, and the sum of both sizes; a pair may occur more than once.

    classes: (class, rep, n_shingles) and perhaps a sketch. Pairs whose sizes or sketches alone rule a link out are left out, and need no sets."""
    sketched = [s for s in SKETCHED if s in classes.columns]
    classes = classes.select("class", "rep", "n_shingles", *sketched)
    left, right = (classes.toDF(x, f"rep_{x}", f"n_{x}", *(f"{s}_{x}" for s in sketched)) for x in "ab")
    pairs = pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    if sketched:
        distance = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in sketched), F.lit(0))
        pairs = pairs.where((100 + percent) * distance <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    pairs = materialize(pairs.select("a", "b", "rep_a", "rep_b"))
    wanted = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("rep_a").alias("rep")), F.struct(F.col("b").alias("class"), F.col("rep_b").alias("rep")))).alias("x")).select("x.class", "x.rep").distinct()
    sets = materialize(sets_of(wanted), "uncompressed")
    both = pairs.join(sets.toDF("b", "rep_b", "right"), ["b", "rep_b"]).join(sets.toDF("a", "rep_a", "left"), ["a", "rep_a"])
    common = F.size(F.array_intersect("left", "right")).cast("long")
    out = materialize(both.select("a", "b", common.alias("common"), (F.size("left") + F.size("right")).cast("long").alias("total")))
    discard(sets, pairs)
    return out


def linked(pairs: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs of `measured` for which 100 * intersection >= percent * union."""
    return pairs.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b").distinct()


#: Whether two sets that meet on their rank_l-th and rank_r-th rarest shingles, and on no rarer one, can have enough in common.
CAN_LINK = "9 * (1 + least(l.n - l.rank, r.n - r.rank)) >= 4 * (l.n + r.n) AND 5 * least(l.n, r.n) >= 4 * greatest(l.n, r.n)"
#: Of two sets that CAN_LINK, the one that isn't larger has so much of itself at or behind the shingle (4 n_l <= 4 n_r in the first test).
CORE = "9 * (1 + n - rank) >= 8 * n"


def link_buckets(small: DataFrame, hot: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) and components (id, component) from the pairs of small buckets and the members (key, class, n, rank) of hot ones.

    The pivot of a bucket is the member with the least share of shingles rarer than the key, so the most typical one."""
    pivot = hot.groupBy("key").agg(F.min(F.struct((F.col("rank") / F.col("n")).alias("share"), "class", "n", "rank")).alias("f")).select("key", "f.class", "f.n", "f.rank")
    starred = hot.alias("l").join(materialize(pivot).alias("r"), F.expr("l.key = r.key")).selectExpr("l.key", "l.class", "l.n", "l.rank", "least(l.class, r.class) AS a", "greatest(l.class, r.class) AS b", f"{CAN_LINK} AS may")
    starred = materialize(starred)
    known = measure(small.unionByName(starred.where("may AND a <> b").select("a", "b")).distinct())
    links = materialize(linked(known))
    groups = materialize(components(links))
    # Of hot buckets, what still lies in several components.
    left = materialize(starred.join(groups.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class")))
    mixed = materialize(left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    apart = known.select("a", "b", (1 - F.col("common") / (F.col("total") - F.col("common"))).alias("apart")).distinct()
    left = left.join(mixed, "key").join(apart, ["a", "b"], "left").selectExpr("key", "class", "n", "rank", "component", f"{CORE} AS core", "IF(a = b, 0D, apart) AS apart")
    left = materialize(left)
    near = "coalesce(abs(l.apart - r.apart) <= 0.2000001, true)"
    rest = left.where("core").alias("l").join(left.alias("r"), F.expr(f"l.key = r.key AND l.class <> r.class AND l.component <> r.component AND {near} AND {CAN_LINK}"))
    rest = materialize(rest.select(F.least("l.class", "r.class").alias("a"), F.greatest("l.class", "r.class").alias("b")).distinct())
    if not rest.isEmpty():
        links = materialize(links.unionByName(linked(measure(rest))).distinct())
        groups = components(links)
    discard(starred)
    return links, groups


def rare_buckets(sets: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that share one of their rarest shingles with few others, and members (key, class, n, rank) of the shingles that more share."""
    rows = materialize(sets.select("class", F.size("hashes").alias("n"), F.explode("hashes").alias("key")))
    often = rows.groupBy("key").agg(F.count("*").alias("often"))
    own = Window.partitionBy("class").orderBy("often", "key")
    prefix = rows.join(often, "key").withColumn("rank", F.row_number().over(own)).where(f"often > 1 AND rank <= n - ceil({percent} * n / 100) + 1")
    prefix = materialize(prefix.select("key", "class", "n", "rank"))
    size = prefix.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    kept = materialize(prefix.join(size, "key"))
    discard(rows, prefix)
    few = kept.where(F.col("size") <= SMALL)
    pairs = few.alias("l").join(few.alias("r"), F.expr(f"l.key = r.key AND l.class < r.class AND {CAN_LINK}")).select(F.col("l.class").alias("a"), F.col("r.class").alias("b")).distinct()
    return pairs, kept.where(F.col("size") > SMALL).select("key", "class", "n", "rank")


def cell_links(cell: pa.Table) -> pa.Table:
    """(class, n): for each class of two blocks the copies that its links in the other block have (one block: in itself).

    cell: (lo, hi, block, class, copies, hashes) of one pair lo <= hi of blocks."""
    cell = cell.sort_by("block").combine_chunks()
    lo, hi = cell["lo"][0].as_py(), cell["hi"][0].as_py()
    block, copies = cell["block"].to_numpy(), cell["copies"].to_numpy()
    sets = cell["hashes"].combine_chunks()
    size = sets.value_lengths().to_numpy().astype(np.int64)
    _, code, often = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = often > 1  # what one class holds alone is in no intersection
    owner = np.repeat(np.arange(len(size)), size)[shared[code]]
    code = (np.cumsum(shared) - 1)[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    left = slice(0, int((block == lo).sum()))
    right = left if lo == hi else slice(left.stop, len(size))
    common = np.zeros((left.stop, len(size[right])), np.int64)
    for first in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(code, [first, first + COLUMNS])
        held = np.zeros((len(size), COLUMNS), np.float32)
        held[owner[i:j], code[i:j] - first] = 1
        common += np.rint(held[left] @ held[right].T).astype(np.int64)
    link = 100 * common >= 80 * (size[left][:, None] + size[right] - common)
    if lo == hi:
        np.fill_diagonal(link, False)
        n = link @ copies
    else:
        n = np.concatenate([link @ copies[right], copies[left] @ link])
    return pa.table({"class": cell["class"], "n": pa.array(n.astype(np.int64))})


def links_inside(sets: DataFrame, about: DataFrame) -> DataFrame:
    """(class, n): the copies that the links of each class among the others of its component have.

    sets: (class, hashes); about: (class, component, copies, n_shingles)."""
    blocks = about.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes")).where("n > 1")
    blocks = materialize(blocks.selectExpr("component", f"cast(greatest(ceil(hashes / {BLOCK_HASHES}), ceil(n / {BLOCK_CLASSES})) AS int) AS blocks"))
    placed = about.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    cells = placed.join(sets.select("class", "hashes"), "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "class", "copies", "hashes")
    return cells.groupBy("component", "lo", "hi").applyInArrow(cell_links, "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))


def link_counts(links: DataFrame, groups: DataFrame, crowded: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, n_links): the documents that each class links with, its own copies left out; `crowded`: the classes in hot buckets."""
    copies = classes.select("class", "copies")
    about = materialize(crowded.join(groups.select(F.col("id").alias("class"), "component"), "class").join(classes.select("class", "copies", "n_shingles"), "class"))
    flags = crowded.select("class", F.lit(True).alias("hot"))
    apart = links.join(flags.toDF("a", "hot_a"), "a", "left").join(flags.toDF("b", "hot_b"), "b", "left").where("hot_a IS NULL OR hot_b IS NULL")
    apart = apart.select(F.inline(F.array(F.struct(F.col("a").alias("to"), F.col("b").alias("class")), F.struct(F.col("b").alias("to"), F.col("a").alias("class")))))
    apart = apart.join(copies, "class").groupBy(F.col("to").alias("class")).agg(F.sum("copies").alias("n"))
    return materialize(apart.unionByName(links_inside(sets, about)).groupBy("class").agg(F.sum("n").alias("n_links")))


def link_documents(docs: DataFrame, count: bool = False) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) of documents (doc_id, text), and with `count` n_links.

    n_links counts the other rows that a row links with: its copies, and all copies of the sets that its set links with."""
    docs = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    dealt = docs.mapInArrow(_emit(n_parts(docs)), DEALT)
    staged = materialize(to_parts(dealt).mapInArrow(_bucket, STAGED))
    members = staged.where("kind = 0").select(F.col("a").alias("class"), F.col("b").alias("doc_id"), F.col("c").alias("n_shingles"), *SKETCHED)
    classes = members.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies"), *(F.max(s).alias(s) for s in SKETCHED))
    classes = materialize(classes)
    hot = staged.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("class"))
    free = staged.where("kind = 3").groupBy(F.col("a").alias("class")).agg(F.min(F.col("d") - F.col("c")).alias("spare"))
    bound = hot.groupBy("class").agg(F.count("*").alias("n")).join(free, "class").where("n >= spare").select("class")
    bound = materialize(bound.join(classes.select("class", "rep"), "class"))
    sets = document_sets(docs, bound).join(bound, ["class", "rep"], "left_semi").dropDuplicates(["class"])
    if count:
        sets = materialize(sets, "uncompressed")
    close, hot = rare_buckets(sets)
    small = staged.where("kind = 1").select("a", "b").unionByName(close)
    hot = materialize(hot)
    links, groups = link_buckets(small, hot, lambda pairs: measured(pairs, classes, lambda wanted: document_sets(docs, wanted)))
    placed = materialize(classes.select("class", "rep", "copies").join(groups.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class")))
    least = materialize(placed.groupBy("component").agg(F.min("rep").alias("component_id")))  # written, so that the join can split what meets in one component
    placed = placed.join(least, "component").select("class", "copies", "component_id")
    if count:
        crowded = materialize(hot.select("class").distinct())
        placed = placed.join(link_counts(links, materialize(groups), crowded, sets, classes), "class", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n_links", F.lit(0)))
    out = members.join(materialize(placed), "class", "left")
    return out.select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"), *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), count=True).select("doc_id", "n_shingles", "component_id", "n_links")
