"""Toxicity: a linear-chain conditional random field over words, with document scores from its marginals.

1. Counts over all labelled training documents give each word and word beginning the number of toxic
   and clean documents that hold it (weak labels: in a toxic document, a word is labelled toxic if its
   beginning or itself occurs significantly more often in toxic documents).
2. The field has two states (other, toxic). Features of a place are hashed: the word, its beginnings and
   ending, and its neighbours. It is trained by stochastic gradient steps on a bounded sample of labelled
   documents (MAX_TRAIN_DOCS), chosen by hash.
3. Forward-backward marginals of every place of every text give the offending spans, and features of
   which a logistic regression on the same sample makes the document's score.

Sequences are sentences of at most CHAIN words (cut at . ! ? and line ends); no state crosses them.

Defined results: empty and null texts have the score of a document without places; null labels are not
learned from; without both labels everything scores 0; a null doc_id is not held out; repeated rows count
as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, table, text_buffers, texts_of, word_hashes, word_spans
from .language import remainder

#: Documents of the training sample; all counts are over all documents.
MAX_TRAIN_DOCS = 6_000
#: Labels (12 bytes each) are broadcast up to this many, else both sides are shuffled.
BROADCAST_LABELS = 1 << 20
BITS = 18
CHAIN = 64
#: Letters, digits and non-ASCII bytes make words here, so that punctuation doesn't hide one.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True
PREFIXES = (4, 5, 6)
SPAN_AT = 0.5


def places(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first place of each row, chain begins, hashes: word, its beginnings, its ending) of all words."""
    starts, ends, first = word_spans(raw, at, WORD)
    n = len(starts)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins = begins[:n]
    if n:
        stops = np.concatenate([[0], np.cumsum(STOP[raw])])
        begins[1:] |= stops[starts[1:]] > stops[ends[:-1]]
        since = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        begins |= since % CHAIN == 0
    forms = [word_hashes(raw, starts, ends)]
    for k in PREFIXES:
        forms.append(mix(word_hashes(raw, starts, np.minimum(starts + k, ends)) + np.uint64(k)))
    forms.append(mix(word_hashes(raw, np.maximum(ends - 4, starts), ends) + np.uint64(99)))
    return starts, ends, first, begins, np.stack(forms) if n else np.zeros((2 + len(PREFIXES), 0), np.uint64)


def slots(forms: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hashed feature slots of each place: own forms, and the words before and after in its chain."""
    n = forms.shape[1]
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if n:
        before[1:] = np.where(begins[1:], 0, forms[0, :-1])
        after[:-1] = np.where(begins[1:], 0, forms[0, 1:])
    rows = [*forms, mix(before + np.uint64(1001)), mix(after + np.uint64(2003))]
    return np.stack([(r >> np.uint64(64 - BITS)).astype(np.int32) for r in rows])


def lattice(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by falling length: (first places, lengths, number of chains longer than t, for each t)."""
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(begins)))
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    return at, size, np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")


def marginals(emit: np.ndarray, begins: np.ndarray, move: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each place and P(toxic, toxic) with the place before it, by forward-backward in log-odds form.

    emit: log potential of toxic against other; move: 2x2 log potentials; all chains advance together."""
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    at, size, wide = lattice(begins)
    a = np.zeros((n, 2))
    first = at
    a[first, 1] = emit[first] + start
    for t in range(1, len(wide)):
        i = at[: wide[t]] + t
        prev = a[i - 1]
        new = np.stack([np.logaddexp(prev[:, 0] + move[0, 0], prev[:, 1] + move[1, 0]), np.logaddexp(prev[:, 0] + move[0, 1], prev[:, 1] + move[1, 1]) + emit[i]], 1)
        a[i] = new - new[:, :1]  # only differences matter
    b = np.zeros((n, 2))
    for t in range(len(wide) - 2, -1, -1):
        i = at[: wide[t + 1]] + t
        nxt = b[i + 1] + np.stack([np.zeros(len(i)), emit[i + 1]], 1)
        new = np.stack([np.logaddexp(nxt[:, 0] + move[0, 0], nxt[:, 1] + move[0, 1]), np.logaddexp(nxt[:, 0] + move[1, 0], nxt[:, 1] + move[1, 1])], 1)
        b[i] = new - new[:, :1]
    own = a + b
    p = 1 / (1 + np.exp(np.clip(own[:, 0] - own[:, 1], -500, 500)))
    pair = np.zeros((n, 2, 2))
    i = np.flatnonzero(~begins)
    joint = a[i - 1][:, :, None] + move[None] + (b[i] + np.stack([np.zeros(len(i)), emit[i]], 1))[:, None, :]
    joint -= joint.max((1, 2), keepdims=True)
    joint = np.exp(joint)
    pair[i] = joint / joint.sum((1, 2), keepdims=True)
    return p, pair


def train_field(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.5) -> dict:
    """Weights that maximise the conditional likelihood of the labels, by AdaGrad over groups of places: (slots, chain begins, labels)."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    move, move2, start, bias = np.zeros((2, 2)), np.full((2, 2), 1.0), -2.0, -4.0
    for _ in range(epochs):
        for s, own, y in groups:
            p, pair = marginals(w[s].sum(0) + bias, own, move, start)
            gap = y - p
            used = np.flatnonzero(np.abs(gap) > 1e-4)
            g = np.bincount(s[:, used].ravel(), np.tile(gap[used], len(s)), minlength=1 << BITS)
            k = np.flatnonzero(g)
            g2[k] += g[k] ** 2
            w[k] += rate * g[k] / np.sqrt(g2[k])
            i = np.flatnonzero(~own)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[i - 1], y[i]), 1)
            gm = (seen - pair[i].sum(0)) / max(1, len(i)) * 100
            move2 += gm**2
            move += 0.1 * gm / np.sqrt(move2)
    return {"w": w.astype(np.float32), "move": move, "start": start, "bias": bias}


def doc_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row: log-odds of its likeliest place, log(1 + expected toxic places), log-odds that any is toxic."""
    n = len(first) - 1
    out = np.zeros((n, 3))
    out[:, 0] = out[:, 2] = -12.0
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        cut = first[:-1][full]
        q = np.clip(p, 1e-6, 1 - 1e-6)
        top = np.maximum.reduceat(q, cut)
        out[full, 0] = np.log(top / (1 - top))
        out[full, 1] = np.log1p(np.add.reduceat(np.where(q > 0.05, q, 0), cut))
        none = np.add.reduceat(np.log1p(-np.where(q > 0.01, q, 0)), cut)
        out[full, 2] = np.clip(np.log(np.maximum(-np.expm1(none), 1e-6)) - none, -12, 12)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _form_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a form, by hashed form: (slot, toxic, clean), one row for each slot of a task."""
    held = np.zeros((2, 1 << 22), np.int32)
    for batch in batches:
        raw, at = text_buffers(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
        for i, j in slices(at):
            _, _, first, _, forms = places(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            for k in range(j - i):
                own = np.unique((forms[: 1 + len(PREFIXES), first[k] : first[k + 1]] >> np.uint64(42)).ravel())
                held[label[i + k], own.astype(np.int64)] += 1
    at = np.flatnonzero(held.any(0))
    for i in range(0, len(at), 1 << 16):
        own = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(held[1, own].astype(np.int64)), pa.array(held[0, own].astype(np.int64))], names=["slot", "toxic", "clean"])


def train(rows: DataFrame) -> dict | None:
    """The model from labelled rows (doc_id, text, label); None unless both labels occur."""
    rows = texts_of(rows.where("label IN (0, 1)"), F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
    totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(totals) < 2:
        return None
    counts = rows.select("text", "label").mapInArrow(_form_counts, "slot long, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Significantly toxic: at least five times the clean rate, with a binomial z of at least 4.
    share = totals[1] / (totals[0] + totals[1])
    hits = counts.where(f"toxic >= 4 AND (toxic + 0.5) / {totals[1]} >= 5 * (clean + 0.5) / {totals[0]} AND toxic - (toxic + clean) * {share} >= 4 * sqrt((toxic + clean) * {share * (1 - share)})")
    lexicon = np.zeros(1 << 22, bool)  # at most 2**22 slots, whatever the input
    lexicon[[r.slot for r in hits.select("slot").collect()]] = True
    n = sum(totals.values())
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, MAX_TRAIN_DOCS / n))).select("text", "label").toPandas()
    texts = pa.array([t or "" for t in sample["text"]], pa.large_string())
    raw, at = text_buffers(texts)
    label = sample["label"].to_numpy()
    parts = []
    for i, j in slices(at):
        _, _, first, begins, forms = places(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        doc = np.repeat(np.arange(i, j), np.diff(first))
        y = (lexicon[(forms[: 1 + len(PREFIXES)] >> np.uint64(42)).astype(np.int64)].any(0) & (label[doc] == 1)).astype(np.int64)
        if len(y):
            parts.append((slots(forms, begins), begins, y))
    field = train_field(parts)
    del parts
    x = []
    for i, j in slices(at):
        _, _, first, begins, forms = places(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        p, _ = marginals(field["w"][slots(forms, begins)].sum(0) + field["bias"], begins, field["move"], field["start"])
        x.append(doc_features(p, first))
    return field | {"doc": fit_logistic(np.concatenate(x), label)}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans): spans are (start, end) byte offsets of places with a marginal of at least SPAN_AT, adjoining ones joined."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            raw, at = text_buffers(batch.column(2))
            scores, spans = [], []
            for i, j in slices(at):
                if m is None:
                    scores += [0.0] * (j - i)
                    spans += [[]] * (j - i)
                    continue
                starts, ends, first, begins, forms = places(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                p, _ = marginals(m["w"][slots(forms, begins)].sum(0) + m["bias"], begins, m["move"], m["start"])
                x = doc_features(p, first)
                scores += (1 / (1 + np.exp(-np.clip(m["doc"][0] + x @ m["doc"][1:], -30, 30)))).tolist()
                hot = np.flatnonzero(p >= SPAN_AT)
                doc = np.searchsorted(first, hot, "right") - 1
                own: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
                before = -2
                for k, d in zip(hot.tolist(), doc.tolist(), strict=True):
                    base = int(at[i + d] - at[i])
                    if k == before + 1 and own[d] and not begins[k]:
                        own[d][-1] = (own[d][-1][0], int(ends[k]) - base)
                    else:
                        own[d].append((int(starts[k]) - base, int(ends[k]) - base))
                    before = k
                spans += own
            items = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), items], names=["doc_id", "held_out", "score", "predicted", "spans"])

    own = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: long, end: long>>")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where(F.col("toxic").isNotNull() & F.coalesce(remainder(5) != 0, F.lit(False))).select("doc_id", F.col("toxic").alias("label")).distinct()
    return docs.select("doc_id", "text").join(F.broadcast(known) if known.count() <= BROADCAST_LABELS else known, "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(training_rows(docs, table(spark, sf_dir, "labels"))))
