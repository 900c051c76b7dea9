"""Token-ID output: texts as token ids in grammar-compressed shards (Re-Pair) that can be read at random.

Shards hold ranges of doc_id, in ascending order (null first; copies of an id by text). A shard is a
sequence of blocks, each a row of a Parquet file:

    shard, block      place in the order
    doc_ids           little-endian int64; null_ids: 1 where the id is null
    n_tokens          ids of each document, with its end id (uint32)
    n_symbols         symbols of each document in `symbols` (uint32)
    base              first nonterminal; smaller symbols are token ids
    rules             two symbols for each nonterminal (uint32 pairs)
    lengths           token ids that each nonterminal expands to (uint32)
    symbols, width    the documents' symbols, of `width` bytes each

No rule crosses the end of a document, so a document is decoded from its own symbols and the rules
alone, and `lengths` finds the symbol that covers any token position.

Re-Pair goes on until no pair of a block occurs LEAST times: a rule takes 12 bytes, and replacing a pair saves
4 at each occurrence, so that at three occurrences it no longer pays.

Defined results: a null or empty text is its end id only; ids are kept as they are, repeated rows stay;
an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix, shuffle_partitions, slices, table, text_buffers, texts_of, word_hashes, word_spans

END_ID = 2
BLOCK_IDS = 1 << 20
LEAST = 4
CACHE_PIECES = 1 << 20
#: Pairs of which so few are counted without leaving out rare ones first.
FEW = 1 << 12
WORD_END = "</w>"
#: Marks of which a run is one piece (an apostrophe, or what a special token is made of, may not be).
MARKS = b".,!?;:*#$%&()[]{}/=+-_~@^"
#: Letters whose lower case is one letter that no normalisation takes apart: runs of them are one piece.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž]+")
BLANKS = np.ones(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0D]] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True

_STATE: dict[str, tuple] = {}


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array with zeros behind where it is shorter, so that adding to it again and again copies it seldom."""
    return array if len(array) >= size else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


class WordEncoder:
    """Encodes whole texts with a tokenizers file, word by word: ids of a word don't depend on what stands beyond white space.

    In such a file a run of letters is one piece, so a word of Latin-1 letters and the marks behind it are encoded apart, and
    each piece's last token ends with WORD_END. A tokenizer for which that doesn't hold (one that keeps white space)
    must be used with by_word=False. Pieces are known by 64-bit hashes; their cache is bounded, and only saves time."""

    def __init__(self, path: str, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the cache: a hash table of the pieces' numbers, and where the ids of each number begin in `pool`, which begins with the end id."""
        self.keys, self.numbers, self.known, self.filled = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0, 1
        self.begin, self.size, self.pool = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), np.full(1 << 17, END_ID, np.uint32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece; -1 where it is not known."""
        out, slot, rest = np.full(len(hashes), -1, np.int64), self._slots(hashes), np.arange(len(hashes))
        while len(rest):
            there = self.keys[slot]
            hit = there == hashes[rest]
            out[rest[hit]] = self.numbers[slot[hit]]
            more = ~hit & (there != 0)
            rest, slot = rest[more], (slot[more] + 1) % len(self.keys)
        return out

    def _enter(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """hashes: distinct, and not known. At most half of the table is filled."""
        if 2 * (self.known + len(hashes)) > len(self.keys):
            old, more = np.flatnonzero(self.keys), 1 << (2 * (self.known + len(hashes))).bit_length()
            hashes, numbers = np.concatenate([self.keys[old], hashes]), np.concatenate([self.numbers[old], numbers])
            self.keys, self.numbers = np.zeros(more, np.uint64), np.zeros(more, np.int32)
        slot, rest = self._slots(hashes), np.arange(len(hashes))
        while len(rest):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[rest[free]]  # of several at one slot, one stays
            own = self.keys[slot] == hashes[rest]
            self.numbers[slot[own]] = numbers[rest[own]]
            rest, slot = rest[~own], (slot[~own] + 1) % len(self.keys)

    def _by_offsets(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            ids = np.array(found.ids, np.uint32)
            cut = np.searchsorted(starts, np.append(begins, 1 << 60))
            for w, a, b in zip(part, cut[:-1], cut[1:], strict=True):
                out[w] = ids[a:b].tobytes()
        return out

    def _ids(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(places of the words in another order, their ids in that order, how many each has)."""
        order, other = [], []
        for k, w in enumerate(words):
            (order if LETTERS.fullmatch(w) else other).append(k)
        parts, order, bodies, sizes = [order[at : at + 500] for at in range(0, len(order), 500)], [], [], []
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join([words[k] for k in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):  # not one piece each
                other += part
                continue
            order += part
            bodies.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        found = self._by_offsets([words[k] for k in other])
        rest = [found[words[k]] for k in other]
        return order + other, np.concatenate([*bodies, np.frombuffer(b"".join(rest), np.uint32)]), np.concatenate([*sizes, np.array([len(b) >> 2 for b in rest], np.int64)])

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes: distinct, and not known."""
        order, ids, size = self._ids(words)
        last, filled = self.known + len(size), self.filled + len(ids)
        self.pool, self.begin, self.size = _room(self.pool, filled), _room(self.begin, last), _room(self.size, last)
        self.pool[self.filled : filled] = ids
        self.begin[self.known : last], self.size[self.known : last] = self.filled + np.cumsum(size) - size, size
        self._enter(hashes[order], np.arange(self.known, last))
        self.known, self.filled = last, filled

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all pieces, and each row's first one (one more entry ends the last)."""
        starts, ends, first = word_spans(raw, at, BLANKS)
        if not len(starts):
            return starts, ends, first
        letter = _LETTER[raw] | (raw == 0xC3)
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        narrow = np.int32 if len(raw) < 1 << 30 else np.int64
        tail = np.arange(1, len(raw) + 1, dtype=narrow)
        tail[_MARK[raw]] = 0
        tail = np.maximum.accumulate(tail, out=tail)[ends - 1].astype(np.int64)  # where the marks at the end begin
        others = np.zeros(len(raw) + 1, narrow)
        np.cumsum(~letter, out=others[1:])
        two = np.flatnonzero((tail > starts) & (tail < ends) & (others[np.minimum(tail, len(raw))] == others[starts]))
        first = first + np.searchsorted(two, first)
        return np.insert(starts, two + 1, tail[two]), np.insert(ends, two, tail[two]), first

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each with END_ID behind, and how many each has."""
        if not self.by_word:
            bodies = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for b in bodies for i in b], np.uint32), np.array([len(b) for b in bodies], np.int64)
        raw, at = text_buffers(column)
        out, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i, j in slices(at):
            own, begin = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            starts, ends, first = self._pieces(own, begin)
            hashes = np.maximum(mix(word_hashes(own, starts, ends, False) + (ends - starts).astype(np.uint64)), np.uint64(1))  # 0: a free slot
            if self.known > CACHE_PIECES:
                self.forget()
            known = self._find(hashes)
            new = np.flatnonzero(known < 0)
            if len(new):
                distinct, where = np.unique(hashes[new], return_index=True)
                where, text = new[where], own.tobytes()
                self._learn(distinct, [text[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
                known[new] = self._find(hashes[new])
            take, size = np.insert(self.begin[known], first[1:], 0), np.insert(self.size[known], first[1:], 1)  # the end id behind each text
            until = np.cumsum(size)
            out.append(self.pool[np.repeat(take - until + size, size) + np.arange(until[-1])])
            n.append(np.diff(until[first[1:] + np.arange(j - i)], prepend=0))
        return np.concatenate(out), np.concatenate(n)


def encoder(path: str, by_word: bool = True) -> WordEncoder:
    if _STATE.get("key") != (path, by_word):
        _STATE.update(key=(path, by_word), encoder=WordEncoder(path, by_word))
    return _STATE["encoder"]


def _next_in_run(at: np.ndarray, key: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs (by position `at`), whether each is an even one in a run of one pair that overlaps itself."""
    run = np.zeros(len(at), bool)
    run[1:] = (at[1:] == after[at[:-1]]) & (key[1:] == key[:-1])
    begin = np.maximum.accumulate(np.where(run, 0, np.arange(len(at))))
    return (np.arange(len(at)) - begin) % 2 == 0


def pick(array: np.ndarray, where: np.ndarray) -> np.ndarray:
    """array[where], for places that are all in range."""
    return np.take(array, where, mode="clip")


def repair(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, symbols of each document) of documents that end before the positions `ends`, until no pair within one occurs `least` times.

    Each round ranks all pairs that occur so often by their count, and replaces each occurrence that outranks both pairs that
    overlap it, where a pair keeps `least` such occurrences; so the most frequent pair is replaced everywhere. Counts of old
    pairs never grow, so after the first round only pairs that were frequent and those beside new symbols are looked at. Pairs are counted by hash, and only those that count are sorted."""
    n = len(ids)
    seq = np.append(ids.astype(np.int64), 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # the symbol behind and before, n: none
    after[ends - 1] = n
    before[0] = before[ends[ends < n]] = n
    alive, look = np.ones(n, bool), np.zeros(n, bool)
    at = np.flatnonzero(after[:n] < n)
    rank = np.zeros(n + 1, np.int32)  # of the pair that begins at a position; 0: none that counts
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(at):
        own, second = pick(seq, at), pick(seq, pick(after, at))
        same = own == second
        own <<= 32
        own |= second
        if len(at) > FEW:  # most pairs are rare: a bin with too few holds none that counts
            bits = min(20, len(at).bit_length())
            bins = own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bins >>= np.uint64(64 - bits)
            bins = bins.view(np.int64)
            full = np.flatnonzero(pick(np.bincount(bins, minlength=1 << bits) >= least, bins))
            at, own, same = pick(at, full), pick(own, full), pick(same, full)
        coded = pa.array(own).dictionary_encode()
        pairs, which = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        even, twin = np.ones(len(at), bool), np.flatnonzero(same)
        even[twin] = _next_in_run(at[twin], own[twin], after)
        often = np.bincount(which[even] if len(twin) else which, minlength=len(pairs))
        good = pick(often >= least, which)
        fit = np.flatnonzero(good & even)
        if not len(fit):
            break
        cand, at, kind = pick(at, fit), pick(at, np.flatnonzero(good)), pick(which, fit)
        counted = np.flatnonzero(often >= least)
        place = np.zeros(len(pairs), np.int32)
        place[counted[np.lexsort((pairs[counted], often[counted]))]] = np.arange(1, len(counted) + 1)
        own = pick(place, kind)
        rank[cand] = own
        # before[] and after[] are n where there is none: the last entry of rank, which stays 0.
        won = np.flatnonzero((own > pick(rank, pick(before, cand))) & (own > pick(rank, pick(after, cand))))
        rank[cand] = 0
        kind = pick(kind, won)
        enough = np.bincount(kind, minlength=len(pairs)) >= least
        most = np.flatnonzero(pick(enough, kind))
        take, kind = pick(cand, pick(won, most)), pick(kind, most)
        used = np.flatnonzero(enough)
        used = used[np.argsort(pairs[used])]
        symbol = np.zeros(len(pairs), np.int64)
        symbol[used] = base + n_rules + np.arange(len(used))
        rules.append(np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1))
        n_rules += len(used)
        right = pick(after, take)
        seq[take] = pick(symbol, kind)
        alive[right] = False
        behind = pick(after, right)
        after[take] = behind
        before[behind] = take  # before[n] is never read
        beside = pick(before, take)
        beside = beside[beside < n]
        if len(at) > n >> 6:
            look[at] = look[take] = look[beside] = True
            at = np.flatnonzero(look & alive)
            at = pick(at, np.flatnonzero(pick(after, at) < n))
            look[:] = False
        else:
            at = np.unique(np.concatenate([at, take, beside]))
            at = at[alive[at] & (after[at] < n)]
    last = np.zeros(n, bool)
    last[np.flatnonzero(alive & (after[:n] == n))] = True
    symbols = seq[:n][alive]
    done = np.flatnonzero(last[alive]) + 1
    return symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), np.diff(done, prepend=0)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many token ids each nonterminal expands to; a rule only uses earlier ones."""
    known = np.zeros(base + len(rules), np.int64)
    known[:base] = 1
    left, rest = rules.astype(np.int64), np.arange(len(rules))
    while len(rest):  # as often as rules are nested
        size = known[left]
        done = size.all(1)
        known[base + rest[done]] = size[done].sum(1)
        left, rest = left[~done], rest[~done]
    return known[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The token ids of a symbol sequence. Each symbol's place follows from the lengths, so each rule is applied once where it stands."""
    lengths = rule_lengths(rules, base) if lengths is None else lengths.astype(np.int64)
    todo = symbols.astype(np.int64)

    def size_of(x: np.ndarray) -> np.ndarray:
        size = np.ones(len(x), np.int64)
        more = x >= base
        size[more] = lengths[x[more] - base]
        return size

    size = size_of(todo)
    until = np.cumsum(size)
    total, whole = int(size.sum()), int(lengths.sum())
    if whole < total // 2:  # each rule once, and its ids then wherever it stands
        pool = np.concatenate([expand(base + np.arange(len(rules)), rules, base, lengths), todo.astype(np.uint32)])
        begin = whole + np.arange(len(todo))
        more = np.flatnonzero(todo >= base)
        begin[more] = (np.cumsum(lengths) - lengths)[todo[more] - base]
        return pool[np.repeat(begin - until + size, size) + np.arange(total)]
    at = until - size
    out = np.empty(total, np.uint32)
    while len(todo):
        more = todo >= base
        out[at[~more]] = todo[~more]
        own, at = rules[todo[more] - base].astype(np.int64), at[more]
        todo, at = np.concatenate([own[:, 0], own[:, 1]]), np.concatenate([at, at + size_of(own[:, 0])])
    return out


def read_range(block, doc: int, start: int, stop: int) -> np.ndarray:
    """Token ids start..stop of the doc-th document of a block row, expanding only the symbols that cover them."""
    rules = np.frombuffer(block["rules"], np.uint32).reshape(-1, 2).astype(np.int64)
    per = np.frombuffer(block["n_symbols"], np.uint32).astype(np.int64)
    first = int(per[:doc].sum())
    symbols = np.frombuffer(block["symbols"], f"<u{block['width']}")[first : first + int(per[doc])].astype(np.int64)
    lengths = np.frombuffer(block["lengths"], np.uint32).astype(np.int64)
    size = np.ones(len(symbols), np.int64)
    size[symbols >= block["base"]] = lengths[symbols[symbols >= block["base"]] - block["base"]]
    until = np.cumsum(size)
    a, b = int(np.searchsorted(until, start, "right")), int(np.searchsorted(until, stop, "left")) + 1
    skip = start - (int(until[a - 1]) if a else 0)
    return expand(symbols[a:b], rules, block["base"], lengths)[skip : skip + stop - start]


BLOCK_SCHEMA = "shard int, block int, docs long, total long, doc_ids binary, null_ids binary, n_tokens binary, n_symbols binary, base int, rules binary, lengths binary, symbols binary, width int"


def _pack(shard: int, block: int, ids: list, n: np.ndarray, tokens: np.ndarray, base: int) -> pa.RecordBatch:
    symbols, rules, per = repair(tokens, np.cumsum(n), base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    row = (
        shard, block, len(ids), len(tokens), np.array([i or 0 for i in ids], np.int64).tobytes(), bytes(i is None for i in ids), n.astype(np.uint32).tobytes(), per.astype(np.uint32).tobytes(),
        base, rules.astype(np.uint32).tobytes(), rule_lengths(rules, base).astype(np.uint32).tobytes(), symbols.astype(f"<u{width}").tobytes(), width,
    )
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int32(), *[pa.binary()] * 3, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])


def encode_shards(docs: DataFrame, path: str, by_word: bool = True, base: int = 49_408) -> DataFrame:
    """The shards of documents (doc_id, text), written to files in the shared folder and read again. base: ids in the vocabulary."""
    docs = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        own = encoder(path, by_word)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids += batch.column(0).slice(at, 256).to_pylist()
                held.append(own.encode(batch.column(1).slice(at, 256)))
                size += len(held[-1][0])
                if size >= BLOCK_IDS:
                    yield _pack(shard, block, ids, np.concatenate([n for _, n in held]), np.concatenate([x for x, _ in held]), base)
                    block, ids, held, size = block + 1, [], [], 0
        if ids:
            yield _pack(shard, block, ids, np.concatenate([n for _, n in held]), np.concatenate([x for x, _ in held]), base)

    # Copies of an id have one place in the order of all: by text.
    ranged = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ranged.mapInArrow(run, BLOCK_SCHEMA))


def document_ids(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    totals = {r.shard: r.total for r in shards.groupBy("shard").agg(F.sum("total").alias("total")).collect()}  # a row for each shard
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard], at = at, at + totals[shard]
    own = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("shard", "block", F.coalesce(F.sum("total").over(own), F.lit(0)).alias("inside"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = before[row["shard"]] + row["inside"]
                rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2).astype(np.int64)
                ids = expand(np.frombuffer(row["symbols"], f"<u{row['width']}"), rules, row["base"], np.frombuffer(row["lengths"], np.uint32))
                n = np.frombuffer(row["n_tokens"], np.uint32).astype(np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                keys = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["null_ids"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.select("shard", "block", "doc_ids", "null_ids", "n_tokens", "base", "rules", "lengths", "symbols", "width").join(places, ["shard", "block"])
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_ids(encode_shards(table(spark, sf_dir, "documents"), default_path()))
