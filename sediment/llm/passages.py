"""Substring dedup: repeated paragraphs by MinHash banding, verified by exact Jaccard, clustered by components.

Paragraphs end at line ends and, as passages are also pasted into lines, at the end of a sentence once
they have MIN_PIECE words. A paragraph's set holds its distinct 5-word shingles of lower-cased words.
Equal paragraphs are one class. Sets get BANDS keys of ROWS minimum hashes each (recall 1 - (1 - s^ROWS)^BANDS: 0.987
for a similarity s of 0.8, 0.9996 for 0.9); paragraphs of less than four shingles can only link with equal sets, for which
one key is enough. Classes that share a key are verified by counting, and clustered by components.

As a paragraph's cuts depend on the text around a pasted passage, passages are also found by windows of MIN_RUN
words, wherever they begin: of each NEAR windows in a row, the ones with the smallest hash are named (winnowing), so
documents that share MIN_RUN + NEAR - 1 words in a row always share a named window. Equal windows are one cluster.

A cluster that occurs more than once, in one document or in several, is repeated. Adjacent and overlapping repeated
paragraphs and windows make a run. Runs of at least MIN_RUN words are returned, split into what is the first of its
cluster and what isn't, which is to be removed. What is kept may overlap what is removed (a near copy that is itself
copied); what is to be removed then goes, and what lies wholly within it isn't returned as kept.

Defined results: null and empty texts have no paragraphs; rows with a null doc_id are left out; repeated
rows of one doc_id with one text are one occurrence each, of which none is removed for the other; ties go to the
smaller doc_id, then to the earlier place; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix, powers, shingle_hashes, slices, table, text_buffers, texts_of, word_hashes, word_spans
from .jaccard import BUFFER_KEYS, DEALT, PIECE_BYTES, SET_SCHEMA, STAGED, _bucket, deal, deal_keys, dealt_batch, is_wanted, link_buckets, measured, n_parts, part_of, rare_buckets, set_batch, to_parts, wanted_filter

MIN_PIECE = 8
MIN_RUN = 25
NEAR = 13
BANDS, ROWS = 6, 3
_WINDOW = np.uint64(0x3C6EF372FE94F82B)
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_SEEDS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, first word, word hashes) of all paragraphs: byte offsets in `raw`, and one more first word that ends the last."""
    starts, ends, first = word_spans(raw, at)
    if not len(starts):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, np.zeros(1, np.int64), np.zeros(0, np.uint64)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    must = np.zeros(len(starts) + 1, bool)  # a paragraph begins before this word
    must[1:-1] = lines[starts[1:]] > lines[ends[:-1]]
    must[first] = True
    may = must.copy()
    may[1:] |= _ENDS[raw[ends - 1]]
    cuts, begun = [0], 0
    where = np.flatnonzero(may)
    for c, hard in zip(where.tolist(), must[where].tolist(), strict=True):
        if c > begun and (hard or c - begun >= MIN_PIECE):
            cuts.append(c)
            begun = c
    cut = np.array(cuts, np.int64)
    row = np.searchsorted(first, cut[:-1], "right") - 1
    return row, starts[cut[:-1]], ends[cut[1:] - 1], cut, word_hashes(raw, starts, ends)


def piece_names(words: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit name of each paragraph's word sequence, as signed numbers."""
    if len(cut) < 2:
        return np.zeros(0, np.int64)
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(cut[:-1], np.diff(cut)).astype(np.uint64)
    return mix(np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15)), cut[:-1]) + np.diff(cut).astype(np.uint64)).view(np.int64)


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width], for all i with a whole window."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def windows(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, 64-bit name) of the named windows of MIN_RUN words; first: each row's first word, and one more."""
    n_out = np.maximum(np.diff(first) - MIN_RUN + 1, 0)
    row = np.repeat(np.arange(len(n_out)), n_out)
    if len(row) < NEAR:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    at = np.arange(len(row)) - np.repeat(np.cumsum(n_out) - n_out, n_out) + np.repeat(first[:-1], n_out)
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ _WINDOW) * up[: len(words)], out=total[1:])
    names = mix((total[at + MIN_RUN] - total[at]) * down[at])
    least = np.where(row[NEAR - 1 :] == row[: len(row) - NEAR + 1], _slide(names, NEAR, np.minimum), np.uint64(0))
    pad = np.zeros(NEAR - 1, np.uint64)
    own = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), NEAR, np.maximum) == names) & (names > 0))
    return row[own], at[own], names[own].view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    for batch in batches:
        raw, at = text_buffers(batch.column(1))
        ids = batch.column(0).to_numpy()
        for i, j in slices(at):
            yield ids[i:j], at[i:j] - at[i], pieces(raw[at[i] : at[j]], at[i : j + 1] - at[i])


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last, start, stop, class): all paragraphs, as words [first, last) and byte offsets in their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, begin, (row, start, end, cut, words) in _batches(batches):
            if len(row):
                base = cut[np.searchsorted(row, row)]  # the first word of the text
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], cut[:-1] - base, cut[1:] - base, start - begin[row], end - begin[row], piece_names(words, cut))], names=["doc_id", "first", "last", "start", "stop", "class"])

    return docs.mapInArrow(run, "doc_id long, first long, last long, start long, stop long, class long")


#: A window in a body: its name, doc_id, first word, first byte, bytes.
_WINDOW_ROW = np.dtype([("name", "<i8"), ("doc", "<i8"), ("word", "<i4"), ("start", "<i4"), ("size", "<i4")])
_FIRST_ROW = np.dtype([("name", "<i8"), ("doc", "<i8"), ("word", "<i4")])


def _first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of name, doc and word; where each name begins; and how often it occurs."""
    rows = rows[np.lexsort((rows["word"], rows["doc"], rows["name"]))]
    cut = np.flatnonzero(np.concatenate([[True], np.diff(rows["name"]) != 0])) if len(rows) else np.zeros(0, np.int64)
    return rows, cut, np.diff(np.append(cut, len(rows)))


def _emit_windows(parts: int):
    """Rows (part, kind, body): kind 1 windows that are alone in their task so far, for their name's part; of others kind 3 the windows, dealt by document, and kind 4 the first, for their name's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            out: list[tuple[int, int, bytes]] = []
            rows, cut, often = _first(np.concatenate(held))
            held.clear()
            alone = np.repeat(often == 1, often)
            deal(out, 1, part_of(rows["name"][alone], parts), rows[alone])
            deal(out, 3, part_of(mix(rows["doc"][~alone].astype(np.uint64)).view(np.int64), parts), rows[~alone])
            first = rows[cut[often > 1]][list(_FIRST_ROW.names)].astype(_FIRST_ROW)
            deal(out, 4, part_of(first["name"].copy(), parts), first)
            return dealt_batch(out)

        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in slices(at):
                own, begin = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first = word_spans(own, begin)
                row, word, names = windows(word_hashes(own, starts, ends), first)
                if len(row):
                    rows = np.empty(len(row), _WINDOW_ROW)
                    rows["name"], rows["doc"], rows["word"], rows["start"], rows["size"] = names, ids[i:j][row], word - first[row], starts[word] - begin[row], ends[word + MIN_RUN - 1] - starts[word]
                    held.append(rows)
                    if sum(map(len, held)) >= BUFFER_KEYS // 2:
                        yield flush()
        if held:
            yield flush()

    return run


def _shared_part(pieces: Iterator[dict[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
    """One part, piece by piece: kind 1 for windows that occur again, kind 0 for the first of each such name. Between pieces it keeps a row for each name."""

    def out(kind: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 1 << 16):
            x = rows[at : at + (1 << 16)]
            word = x["word"].astype(np.int64)
            start = x["start"].astype(np.int64) if kind else word
            size = x["size"].astype(np.int64) if kind else word
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in (x["doc"], word, word + MIN_RUN, start, start + size, x["name"]))], names=["kind", "doc_id", "first", "last", "start", "stop", "cluster"])

    alone, firsts = np.zeros(0, _WINDOW_ROW), np.zeros(0, _FIRST_ROW)
    for bodies in pieces:
        yield from out(1, np.frombuffer(b"".join(bodies[3]), _WINDOW_ROW))
        rows, cut, often = _first(np.concatenate([alone, np.frombuffer(b"".join(bodies[1]), _WINDOW_ROW)]))
        marks = np.concatenate([firsts, np.frombuffer(b"".join(bodies[4]), _FIRST_ROW)])
        shared = (often > 1) | np.isin(rows["name"][cut], marks["name"])
        marks = np.concatenate([marks, rows[cut[shared]][list(_FIRST_ROW.names)].astype(_FIRST_ROW)])
        marks, cut, _ = _first(marks)
        firsts = marks[cut]
        shared = np.repeat(shared, often)
        yield from out(1, rows[shared])
        alone = rows[~shared]
    yield from out(0, firsts)


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[tuple[int, dict[int, list[bytes]]]]:
        part, size, bodies = None, 0, {k: [] for k in (1, 3, 4)}
        for batch in batches:
            for p, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size and (p != part or size >= PIECE_BYTES):
                    yield part, bodies
                    size, bodies = 0, {k: [] for k in (1, 3, 4)}
                part = p
                bodies[kind].append(body)
                size += len(body)
        if size:
            yield part, bodies

    for _, own in groupby(pieces(), lambda x: x[0]):
        yield from _shared_part(bodies for _, bodies in own)


def shared_windows(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, first, last, start, stop, cluster, kept): the named windows that occur more than once; kept: the first of its cluster."""
    dealt = docs.mapInArrow(_emit_windows(parts), DEALT)
    found = materialize(to_parts(dealt).mapInArrow(_shared_windows, "kind int, doc_id long, first long, last long, start long, stop long, cluster long"))
    firsts = found.where("kind = 0").select("cluster", F.col("doc_id").alias("first_doc"), F.col("first").alias("first_word"))
    return found.where("kind = 1").join(firsts, "cluster").select("doc_id", "first", "last", "start", "stop", "cluster", F.expr("doc_id = first_doc AND first = first_word").alias("kept"))


def _emit(parts: int):
    """Rows (part, kind, body) of the keys of all paragraphs, for `_bucket`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0

        def flush() -> pa.RecordBatch:
            out: list[tuple[int, int, bytes]] = []
            rows = np.stack([np.concatenate(keys).view(np.int64), np.concatenate(owners)], 1)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
            deal_keys(out, rows[new, 0].copy(), rows[new, 1].copy(), parts)
            keys.clear(), owners.clear()
            return dealt_batch(out)

        for _, _, (row, _, _, cut, words) in _batches(batches):
            if not len(row):
                continue
            names = piece_names(words, cut)
            shingles, at = shingle_hashes(words, cut)
            _, once = np.unique(names, return_index=True)
            for band in range(BANDS):
                # Sets of fewer shingles link with equal ones only; sequences shorter than a shingle have no other like them.
                own = once[(np.diff(at)[once] >= 4) | ((np.diff(cut)[once] >= 5) & (band == 0))]
                key = np.full(len(own), np.uint64(band + 1), np.uint64)
                for k in range(band * ROWS, (band + 1) * ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(mix(shingles * _SEEDS[k]), at[:-1])[own])
                keys.append(key)
                owners.append(names[own])
                held += len(own)
            if held >= BUFFER_KEYS:
                yield flush()
                held = 0
        if held:
            yield flush()

    return run


def piece_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, rep, hashes) of the paragraphs asked for, each from its document `rep`."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = sent.value
        for ids, _, (row, _, _, cut, words) in _batches(batches):
            if not len(row):
                continue
            names = piece_names(words, cut)
            shingles, at = shingle_hashes(words, cut)
            out, seen = [], set()
            for k in np.flatnonzero(np.diff(cut) >= 5).tolist():
                name, doc = int(names[k]), int(ids[row[k]])
                if (name, doc) not in seen and is_wanted(bloom, name, doc):
                    seen.add((name, doc))
                    out.append((name, doc, np.unique(shingles[at[k] : at[k + 1]])))
            if out:
                yield set_batch(out)

    return docs.mapInArrow(run, SET_SCHEMA)


def paragraph_clusters(docs: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """(class, cluster, rep) of the classes in `found` (occurrences) whose cluster occurs more than once; rep: the least document that holds it."""
    classes = materialize(found.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    staged = materialize(to_parts(docs.mapInArrow(_emit(parts), DEALT)).mapInArrow(_bucket, STAGED))
    # Classes of crowded buckets are joined on their rarest shingles instead, which loses none of their links.
    crowded = materialize(staged.where("kind = 2").select(F.col("b").alias("class")).distinct().join(classes.select("class", "rep"), "class"))
    close, hot = rare_buckets(piece_sets(docs, crowded).join(crowded, ["class", "rep"], "left_semi").dropDuplicates(["class"]))
    small = staged.where("kind = 1").select("a", "b").unionByName(close)
    # Shingles of a paragraph may repeat; so its size isn't known yet, and verification counts.
    known = classes.select("class", "rep", F.lit(1).alias("n_shingles"))
    _, groups = link_buckets(small, materialize(hot), lambda pairs: measured(pairs, known, lambda wanted: piece_sets(docs, wanted)))
    placed = materialize(classes.join(groups.select(F.col("id").alias("class"), "component"), "class", "left"))
    alone = placed.where("component IS NULL AND n > 1").select("class", F.col("class").alias("cluster"), "rep")
    linked = placed.where("component IS NOT NULL").select("class", F.col("component").alias("cluster"), F.col("rep").alias("own"))
    least = materialize(linked.groupBy("cluster").agg(F.min("own").alias("rep")))
    out = materialize(alone.unionByName(linked.join(least, "cluster").select("class", "cluster", "rep")))
    discard(staged, placed)
    return out


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, n_words, n_pieces, remove, clusters) of documents (doc_id, text): runs of repeated paragraphs (n_pieces) and windows, as UTF-8 byte offsets."""
    docs = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    parts = n_parts(docs)
    found = materialize(occurrences(docs))
    marked = found.join(paragraph_clusters(docs, found, parts), "class")
    first = F.min("first").over(Window.partitionBy("doc_id", "cluster"))
    marked = marked.select("doc_id", "first", "last", "start", "stop", "cluster", ((F.col("doc_id") == F.col("rep")) & (F.col("first") == first)).alias("kept"), F.lit(False).alias("window"))
    marked = marked.unionByName(shared_windows(docs, parts).withColumn("window", F.lit(True)))

    def islands(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy("first", "last", "start", "cluster")
        begins = F.coalesce(F.col("first") > F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        return rows.withColumn("begins", begins.cast("long")).withColumn(name, F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")

    whole = Window.partitionBy("doc_id", "run")
    marked = islands(marked, "run", "doc_id").withColumn("words", F.max("last").over(whole) - F.min("first").over(whole)).where(F.col("words") >= MIN_RUN)
    runs = islands(marked, "island", "doc_id", "run", "kept").groupBy("doc_id", "run", "kept", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("last") - F.min("first")).alias("n_words"), F.count_if(~F.col("window")).alias("n_pieces"), F.array_sort(F.collect_set("cluster")).alias("clusters")
    )
    # What is the first of its cluster, but lies within what is to be removed, isn't kept.
    so_far = Window.partitionBy("doc_id", "run").orderBy("start", "kept").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("gone", F.max(F.when(~F.col("kept"), F.col("stop"))).over(so_far)).where("NOT kept OR gone IS NULL OR gone < stop")
    return runs.select("doc_id", "start", "stop", "n_words", "n_pieces", (~F.col("kept")).alias("remove"), "clusters")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"))
