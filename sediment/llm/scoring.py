"""Language-model scoring by online logistic context mixing over the bits of texts.

A text is its words (A-Z lower-cased), each with a blank behind, then one end, and belongs to a class z. Its score is

    log10 P(text) = log10 P(z) + sum over the bits of all these bytes, in their order, of log10 P(bit | bits before it),

so it is a lower bound of the log probability of the text under the mixture of classes. The classes are the
languages (column lang) of the training texts, each with the trigram counts of all its training texts; z is the
likeliest one by the text's own trigrams alone. Without languages all texts are of one class; texts without one are
learned from as the class that their trigrams tell. More than MAX_CLASSES languages are an error.

Hashed contexts (the last 1, 2, 3 and 4 bytes, the shorter ones with z; the word so far; the word so far and the word
before it; each with the bits of the byte so far) hold counts of zeros and ones. Their log-odds are added with weights
from a set that is gated by how often the two word contexts were seen and by the place of the bit. An adaptive table
over the last byte and the mixed log-odds refines the result.

Learning is online, over the whole running text of all training texts: a step predicts its bits from what was seen
before it, moves the weights by the gradient of the coding cost, and only then adds its bits to the adaptive table and
to the counts. Texts are dealt by hash to parts of about PART_BYTES, and learned from in the order of a hash in each;
then counts and adaptive tables are added up, and weights averaged. Scoring reads what was learned and changes nothing.

In queries these loops run in the JVM, in BitMixer.java; classify, token_text, learn and bit_costs are their plain form,
which gives the same results but for rounding.

Defined results: a null text is empty, and an empty text is one end of class 0; a null doc_id is not held out;
without training texts the counts are 0 and each bit is one half; repeated rows are scored one by one and count as
often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, materialize, powers, slices, table, text_buffers, texts_of, word_hashes, word_spans
from .jvm import ints, map_rows, sent
from .language import LETTERS, remainder, trigrams

TOP = 1 << 18
#: Predictors, and the largest table of one, as a power of two.
PREDICTORS, TOP_BITS = 6, 22
RATE = 0.02
#: Bytes to a step of learning, and to a pass of scoring.
STEP_BYTES, PASS_BYTES = 1 << 12, 1 << 13
GATES = 16 * 8
APM = 256 * 33
#: Ranges of slots, of at most 2^16 each.
CHUNKS = 256
#: Bytes of texts to a part of the training, and the most parts.
PART_BYTES, MOST_PARTS = 1 << 26, 256
MAX_CLASSES, DIMS = 1 << 10, 1 << 12
BLANK, END = 0x20, 0x0A
_MUL, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.arange(4)[:, None]
#: For each place of a bit, high ones first, and each byte: the bit, and the bits of the half byte before it, below a leading one.
BITS = (np.arange(256) >> (7 - np.arange(8)[:, None])) & 1
NODES = np.concatenate([(1 << _PLACE) | (half >> (4 - _PLACE)) for half in (np.arange(256) >> 4, np.arange(256) & 15)])


def class_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    grams, cut = trigrams(raw, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(cut))
    grams = grams[: cut[-1]]
    return np.bincount(doc[grams >= 0] * DIMS + (grams[grams >= 0] >> 4), minlength=(len(at) - 1) * DIMS).reshape(-1, DIMS)


def fit_classes(docs: DataFrame) -> np.ndarray:
    """Log probabilities of trigrams (DIMS rows) in each class, from all of (text, lang) with a lang; classes are in order of their names."""
    names = [r.lang for r in docs.where("lang IS NOT NULL").select("lang").distinct().limit(MAX_CLASSES + 1).collect()]
    if len(names) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages")
    place = {name: k for k, name in enumerate(sorted(names))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), DIMS), np.int64)
        for batch in batches:
            raw, at = text_buffers(batch.column(0))
            z = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j in slices(at):
                grams, cut = trigrams(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                grams, kind = grams[: cut[-1]], np.repeat(z[i:j], np.diff(cut))
                sums += np.bincount(kind[grams >= 0] * DIMS + (grams[grams >= 0] >> 4), minlength=sums.size).reshape(sums.shape)
        z, dim = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(sums[z, dim])], names=["z", "dim", "n"])

    counts = np.zeros((max(1, len(place)), DIMS))
    if place:
        summed = texts_of(docs.where("lang IS NOT NULL"), F.col("text"), F.col("lang")).mapInArrow(count, "z int, dim int, n long").groupBy("z", "dim").agg(F.sum("n").alias("n"))
        for r in summed.collect():  # at most DIMS rows a class
            counts[r.z, r.dim] = r.n
    share = counts.sum(0) / max(1.0, counts.sum())
    return np.log((counts + 20 * share + 0.01) / (counts.sum(1, keepdims=True) + 20 * share.sum() + 0.01 * DIMS)).T


def classify(model: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1, np.int64)
    for i in range(0, len(out), 64):
        own = at[i : i + 65]
        out[i : i + 64] = np.argmax(class_counts(raw[own[0] : own[-1]], own - own[0]) @ model, 1)
    return out


def token_text(raw: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is predicted of some texts with these words: the words, each with a blank behind, and an end; and where each text begins."""
    sizes = ends - starts + 1
    begin = np.zeros(len(at), np.int64)
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    begin[:] = total[first] + np.arange(len(at))
    to = total[:-1] + np.repeat(np.arange(len(at) - 1), np.diff(first))
    out = np.full(begin[-1], BLANK, np.uint8)
    if len(starts):
        inside = np.repeat(starts - (total[:-1] - np.arange(len(starts))), sizes - 1) + np.arange(total[-1] - len(starts))
        out[inside + np.repeat(to - starts, sizes - 1)] = LOWER[raw[inside]]
    out[begin[1:] - 1] = END
    return out, begin


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, each with a blank behind, and where they begin."""
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    return raw, at


def byte_contexts(raw: np.ndarray, at: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context numbers (one row for each predictor) of all bytes of some texts, and the byte before each in its text (0: none)."""
    n = len(raw)
    index = np.arange(n)
    begin = np.repeat(at[:-1], np.diff(at))
    place = index - begin
    rows = np.empty((PREDICTORS, n), np.uint64)
    kind = np.repeat(z.astype(np.uint64) << np.uint64(54), np.diff(at))
    mixed, before = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(1, 5):
        last = np.zeros(n, np.uint64)
        last[k:] = raw[:-k]
        last[place < k] = 0
        mixed = mixed * np.uint64(257) + last
        np.add(mixed, np.uint64(k << 50), out=rows[k - 1])
        if k < 4:
            rows[k - 1] += kind
        if k == 1:
            before = last.astype(np.int64)
    # The word so far: a window of a sum of bytes times powers, as in word_hashes.
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    opens = np.zeros(n, bool)
    opens[1:] = raw[:-1] == BLANK
    opens[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(opens)
    word = np.cumsum(opens) - 1
    whole = (total[np.append(start[1:], n)] - total[start]) * down[start]
    previous = np.zeros(len(start), np.uint64)
    previous[1:] = np.where(place[start[1:]] > 0, whole[:-1], 0)
    rows[4] = (total[:n] - total[start][word]) * down[start][word] + np.uint64(5)
    rows[5] = rows[4] * _MUL2 + (previous ^ (previous >> np.uint64(31)))[word] * _MUL + np.uint64(7)
    return rows, before


def table_bits(size: int) -> tuple[int, ...]:
    """Slots of each predictor, as powers of two, for so many bytes of training texts."""
    top = min(TOP_BITS, max(16, int(size).bit_length() + 1))
    return (min(top, 18), min(top, 20), top - 1, top, top, top)


def bit_slots(contexts: np.ndarray, words: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each predictor for all bits (the first bits of all bytes, then the second ones, and so on), and the bits. Half a byte's slots lie together."""
    n = len(words)
    nodes = np.take(NODES, words, 1)
    high = ((words >> 4).astype(np.uint64) + np.uint64(1)) * _MUL
    slots, base = np.empty((len(sizes), 8, n), np.int64), 0
    for k, size in enumerate(sizes):
        h = contexts[k] * _MUL
        h ^= h >> np.uint64(29)
        for part, own in ((0, h), (4, h + high)):
            own = own * _MUL2
            own ^= own >> np.uint64(32)
            own *= _MUL
            own >>= np.uint64(68 - size)
            own <<= np.uint64(4)
            own += np.uint64(base)
            np.add(own.view(np.int64), nodes[part : part + 4], out=slots[k, part : part + 4])
        base += 1 << size
    return slots.reshape(len(sizes), 8 * n), np.take(BITS, words, 1).ravel()


def new_model(sizes: tuple[int, ...], counts: np.ndarray) -> dict:
    return {"sizes": sizes, "counts": counts, "weights": np.full((GATES, PREDICTORS + 1), 0.3) * np.array([1] * PREDICTORS + [0]), "apm": np.zeros((APM, 2))}


def log_odds(n: np.ndarray) -> np.ndarray:
    """Of counts of zeros and ones."""
    n = n.astype(np.float32)
    n += np.float32(0.4)
    return np.log(n[:, 1] / n[:, 0])


def levels(n: np.ndarray) -> np.ndarray:
    """0 to 3: how often a context was seen."""
    n = n[:, 0].astype(np.int64) + n[:, 1]
    return (n > 0).view(np.uint8) + (n > 2).view(np.uint8) + (n > 15).view(np.uint8)


def slot_pairs(counts: np.ndarray) -> np.ndarray:
    """The zeros and ones of each slot as one number, in place."""
    return counts.view(f"u{2 * counts.itemsize}").ravel()


def mixed_odds(model: dict, slots: np.ndarray, bits: np.ndarray, keep: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """(inputs, gates, log-odds of a one) for all bits, from the counts, or from `odds` and `levels` where they were worked out; inputs only if `keep`."""
    n = len(bits)
    inputs = np.empty((PREDICTORS + 1, n), np.float32)
    inputs[-1] = 0.3
    gates = np.zeros(n, np.int64)
    pairs = None if model["counts"] is None else slot_pairs(model["counts"])
    for k in range(PREDICTORS):
        if pairs is None:
            np.take(model["odds"], slots[k], out=inputs[k], mode="clip")
            seen = np.take(model["levels"], slots[k] - model["level_base"], mode="clip") if k >= PREDICTORS - 2 else None
        else:
            own = np.take(pairs, slots[k], mode="clip").view(model["counts"].dtype).reshape(-1, 2)
            inputs[k] = log_odds(own)
            seen = levels(own) if k >= PREDICTORS - 2 else None
        if seen is not None:
            gates = gates * 4 + seen
    gates = (gates.reshape(8, -1) * 8 + np.arange(8)[:, None]).ravel()
    odds = np.zeros(n, np.float32)
    for k, weights in enumerate(model["weights"].T.astype(np.float32)):
        odds += inputs[k] * np.take(weights, gates, mode="clip")
    return inputs if keep else None, gates, np.clip(odds, -30, 30, out=odds)


def apm_rows(odds: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.tile(before * 33 + 16, 8) + np.clip(np.rint(odds * 2), -16, 16).astype(np.int64)


def refined(model: dict, odds: np.ndarray, before: np.ndarray) -> np.ndarray:
    """P(one): the mean of the mixed probability and what the adaptive table saw where the mix said so; never nearer to 0 or 1 than 2^-20."""
    p = 1 / (1 + np.exp(-odds))
    rows = apm_rows(odds, before)
    zeros, ones = model["apm"].T.astype(np.float32)
    ones, both = ones[rows], (zeros + ones + np.float32(20))[rows]
    return np.clip((p + (ones + 20 * p) / both) / 2, 2**-20, 1 - 2**-20)


def learn(model: dict, raw: np.ndarray, at: np.ndarray, z: np.ndarray) -> int:
    """Online steps over some texts: predict, then learn weights, adaptive table and counts; returns the bits seen."""
    contexts, before = byte_contexts(raw, at, z)
    weights, apm, pairs = model["weights"], model["apm"], slot_pairs(model["counts"])
    one_more = slot_pairs(np.eye(2, dtype=model["counts"].dtype))  # of a slot's zeros, of its ones
    for a in range(0, len(raw), STEP_BYTES):
        part = slice(a, a + STEP_BYTES)
        slots, bits = bit_slots(contexts[:, part], raw[part], model["sizes"])
        inputs, gates, odds = mixed_odds(model, slots, bits, True)
        gap = (bits - 1 / (1 + np.exp(-odds))).astype(np.float32)
        seen = np.maximum(np.bincount(gates, minlength=GATES), 64)
        for k in range(PREDICTORS + 1):
            weights[:, k] += RATE * 8 * np.bincount(gates, gap * inputs[k], minlength=GATES) / seen
        apm += np.bincount(apm_rows(odds, before[part]) * 2 + bits, minlength=2 * APM).reshape(APM, 2)
        more = one_more[bits]
        for k in range(PREDICTORS):
            np.add.at(pairs, slots[k], more)
    return len(raw) * 8


def bit_costs(model: dict, raw: np.ndarray, at: np.ndarray, z: np.ndarray) -> np.ndarray:
    """log10 of the probability of each of some texts."""
    contexts, before = byte_contexts(raw, at, z)
    cost = np.empty(len(raw))
    for a in range(0, len(raw), PASS_BYTES):
        part = slice(a, a + PASS_BYTES)
        slots, bits = bit_slots(contexts[:, part], raw[part], model["sizes"])
        p = refined(model, mixed_odds(model, slots, bits, False)[2], before[part])
        cost[part] = np.log10(np.abs(1 - bits.astype(np.float32) - p)).reshape(8, -1).sum(0, dtype=np.float64)
    return np.add.reduceat(cost, at[:-1]) if len(at) > 1 else np.zeros(0)


def _text_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, begins) of groups of texts (column 0) of bounded size, which are the same however the texts came in batches."""
    held = None
    for batch in batches:
        column = batch.column(0) if held is None else pa.concat_arrays([held, batch.column(0)])
        raw, at = text_buffers(column)
        *groups, (i, _) = list(slices(at)) or [(0, 0)]
        for a, b in groups:
            yield raw[at[a] : at[b]], at[a : b + 1] - at[a]
        held = column.slice(i)
    if held is not None and len(held):
        yield text_buffers(held)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers with equal bytes of all of them together, which compresses."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def used_slots(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Places and counts of the slots of a range that were seen."""
    used = np.flatnonzero(counts.any(1))
    return used.astype(np.uint16).tobytes(), _planes(counts[used].ravel())


def add_slots(total: np.ndarray, places: bytes, counts: bytes) -> None:
    total[np.frombuffer(places, np.uint16)] += _unplaned(counts).reshape(-1, 2)


def sent_classes(spark: SparkSession, classes: np.ndarray) -> tuple:
    """What tells the class of a text, for BitMixer.java."""
    return sent(spark, "BitMixer", LETTERS[LOWER].tobytes()), sent(spark, "BitMixer", np.ascontiguousarray(classes, np.float64).tobytes())


def mixed_costs(texts: DataFrame, model: dict, classes: np.ndarray) -> DataFrame:
    """(doc_id, text, held_out, z, cost) of (doc_id, text, held_out): the class of each text, and bit_costs of it."""
    spark = texts.sparkSession
    parts = (sent(spark, "BitMixer", model[name].tobytes()) for name in ("odds", "levels", "weights", "apm"))
    rows = texts.select("doc_id", F.col("text").cast("binary").alias("text"), "held_out")
    return map_rows(rows, "BitMixer", "Score", "doc_id long, text binary, held_out boolean, z int, cost double", ints(spark, model["sizes"]), *sent_classes(spark, classes), *parts)


def train(texts: DataFrame, size: int, classes: np.ndarray) -> dict:
    """The model of all of (doc_id, text), of so many bytes together."""
    sizes = table_bits(size)
    slots, parts = sum(1 << b for b in sizes), max(1, min(MOST_PARTS, -(-size // PART_BYTES)))
    width = -(-slots // CHUNKS)
    level_base = sum(1 << b for b in sizes[:-2])
    spark = texts.sparkSession

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, places, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if c not in sums:
                    sums[c] = np.zeros((min(width, slots - c * width), 2), np.int64)
                add_slots(sums[c], places.as_py(), n.as_py())
        for c, n in sums.items():
            seen = levels(n)[max(0, level_base - c * width) :]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([log_odds(n).astype(np.float16).tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=["chunk", "odds", "levels"])

    # Parts and their order follow from the rows alone, so that any layout gives one model; equal rows can stand for each other.
    key = F.xxhash64("doc_id", "text")
    dealt = texts.select("doc_id", "text", key.alias("key")).repartition(parts, "key").sortWithinPartitions("key", "doc_id", "text")
    learned = materialize(map_rows(dealt.select(F.col("text").cast("binary")), "BitMixer", "Learn", "chunk int, part int, n long, a binary, b binary, c binary", ints(spark, sizes), CHUNKS, *sent_classes(spark, classes)))
    model = new_model(sizes, None) | {"odds": np.zeros(slots, np.float16), "levels": np.zeros(slots - level_base, np.uint8), "level_base": level_base, "kinds": np.zeros(classes.shape[1], np.int64)}
    total, weights = 0, np.zeros_like(model["weights"])
    for row in learned.where("chunk < 0").orderBy("part").toLocalIterator():  # 150 kB a part, of MOST_PARTS at most
        weights += row["n"] * np.frombuffer(row["a"]).reshape(weights.shape)
        model["apm"] += np.frombuffer(row["b"]).reshape(APM, 2)
        model["kinds"] += np.frombuffer(row["c"], np.int64)
        total += row["n"]
    if total:
        model["weights"] = weights / total
    summed = learned.where("chunk >= 0").select("chunk", "a", "b").repartition(CHUNKS // 8, "chunk").mapInArrow(add, "chunk int, odds binary, levels binary")
    for row in materialize(summed).toLocalIterator():  # at most three bytes a slot, chunk by chunk
        at = row["chunk"] * width
        model["odds"][at : at + width] = np.frombuffer(row["odds"], np.float16)
        seen = np.frombuffer(row["levels"], np.uint8)
        model["levels"][max(0, at - level_base) :][: len(seen)] = seen
    return model


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n, n_all) of (text, held_out): hashes of lower-cased words with their counts in training texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffers(batch.column(0))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            hashes, trained = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for i, j in slices(at):
                own = raw[at[i] : at[j]]
                starts, ends, first = word_spans(own, at[i : j + 1] - at[i])
                hashes.append(word_hashes(own, starts, ends))
                trained.append(np.repeat(~held[i:j], np.diff(first)))
            h, code, n_all = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            n = np.bincount(code, np.concatenate(trained), minlength=len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(n_all.astype(np.int64))], names=["h", "n", "n_all"])

    parts = texts_of(docs, F.col("text"), F.col("held_out")).mapInArrow(run, "h long, n long, n_all long")
    return parts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of documents (doc_id, text, and lang if there is one)."""
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"))
    training = docs.where("NOT held_out")
    n_ends, size = training.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    classes = fit_classes(training)
    model = train(training, size, classes)
    counted = materialize(count_words(docs))
    total = counted.agg(F.sum("n").alias("words"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    n_train, v_train = (total.words or 0) + n_ends, (total["distinct"] or 0) + (n_ends > 0)
    base_total = float(np.log10(n_train + 1 * (v_train + 1)))
    terms = counted.select("h", "n_all", (F.col("n") > 0).cast("long").alias("known"), (F.log10(F.col("n") + 1) - base_total).alias("base"))
    prior = np.log10((model["kinds"] + 1) / (model["kinds"] + 1).sum())
    # The most frequent words: a count at which at most TOP words are left.
    by_count = sorted(((r.n_all, r["count"]) for r in terms.where("n_all > 1").groupBy("n_all").count().collect()), reverse=True)  # one row for each count that occurs
    least, held = 1 << 62, 0
    for n, k in by_count:
        if held + k > TOP:
            break
        least, held = n, held + k
    top = sorted(((r.h, r.known, r.base) for r in terms.where(F.col("n_all") >= least).collect()))
    words = spark.sparkContext.broadcast((np.array([t[0] for t in top], np.int64), np.array([t[1:] for t in top], float).reshape(-1, 2)))
    end_terms = (int(n_ends > 0), float(np.log10(n_ends + 1)) - base_total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, values = words.value
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "model", "h", "tf"]

        def emit(n: int, **own) -> pa.RecordBatch:
            types = {"held_out": pa.bool_(), "base": pa.float64(), "model": pa.float64()}
            return pa.RecordBatch.from_arrays([pa.array(own[c], types.get(c, pa.int64())) if c in own else pa.nulls(n, types.get(c, pa.int64())) for c in names], names=names)

        for batch in batches:
            ids, held_out = batch.column(0), batch.column(2)
            scores = batch.column(4).to_numpy() + prior[batch.column(3).to_numpy()]
            raw, at = text_buffers(batch.column(1))
            for i, j in slices(at):
                text, begin = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first = word_spans(text, begin)
                h = word_hashes(text, starts, ends).view(np.int64)
                where = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                found = keys[where] == h if len(keys) else np.zeros(len(h), bool)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                sums = [np.bincount(doc[found], values[where[found], k], minlength=j - i) for k in range(2)]
                n = np.diff(first) + 1
                yield emit(j - i, row=row + np.arange(j - i), doc_id=ids.slice(i, j - i), held_out=held_out.slice(i, j - i), n_tokens=n, n_bytes=np.diff(begin), known=np.rint(sums[0]).astype(np.int64) + end_terms[0], base=sums[1] + end_terms[1], model=scores[i:j])
                rest = np.flatnonzero(~found)
                if len(rest):
                    order = np.lexsort((h[rest], doc[rest]))
                    d, w = doc[rest][order], h[rest][order]
                    cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
                    yield emit(len(cut), row=row + d[cut], h=w[cut], tf=np.diff(np.append(cut, len(d))))
                row += j - i

    scored = texts_of(mixed_costs(docs, model, classes), *map(F.col, ("doc_id", "text", "held_out", "z", "cost")))
    staged = materialize(scored.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, model double, h long, tf long"))
    rare = staged.where("h IS NOT NULL").select("row", "h", "tf").join(terms.where(F.col("n_all") < least).drop("n_all"), "h")
    summed = rare.groupBy("row").agg(F.sum(F.col("tf") * F.col("known")).alias("k"), F.sum(F.col("tf") * F.col("base")).alias("b"))
    texts = staged.where("h IS NULL").drop("h", "tf").join(summed, "row", "left")
    return texts.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), F.col("model").alias("score"), F.when(F.col("n_bytes") > 0, F.col("model") * (-float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
