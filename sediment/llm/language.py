"""Language identification by multilingual mixture inference.

Training counts hashed letter trigrams (as bytes) of each language over all labelled training texts.
For a text, expectation-maximisation estimates the proportions of the languages that its trigrams come
from; the set of languages is the one that a likelihood penalised for its size prefers.

Defined results: `und` with score 0 for a null text, one without letters, or when nothing was learned;
rows with a null label are not learned from; a null doc_id is not held out; ties go to the language
that sorts first; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_buffers, texts_of

BITS = 16
#: The model holds 2**BITS counts for each language, at most this many languages: a bound of 512 MB, 2 MB for four.
MAX_LANGUAGES = 1024
PENALTY = 3.0
UNDETERMINED = "und"
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def remainder(by: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all rows, and where each row's begin; a row is framed by blanks, and what has no letter is a blank."""
    n = np.diff(at)
    framed = np.full(len(raw) + 3 * len(n) + 2, 32, np.uint8)
    framed[np.arange(len(raw)) + np.repeat(3 * np.arange(len(n)) + 1, n)] = LETTERS[raw]
    a = framed.astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    hashed = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    hashed[code == 0x202020] = -1
    cut = np.append(at[:-1] + 3 * np.arange(len(n)), len(raw) + 3 * len(n))
    hashed[cut[1:] - 1] = -1  # two blanks and the first byte of the next row
    return hashed, cut


def train(docs: DataFrame, label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and for each trigram and language its log probability, from all of (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, at = text_buffers(batch.column(0))
            names = np.array(batch.column(1).to_pylist(), object)
            for name in set(names):
                counts.setdefault(name, np.zeros(1 << BITS, np.int64))
            for i, j in slices(at):
                grams, cut = trigrams(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                for name in set(names[i:j]):
                    own = np.concatenate([grams[cut[k] : cut[k + 1]] for k in np.flatnonzero(names[i:j] == name)])
                    counts[name] += np.bincount(own[own >= 0], minlength=1 << BITS)
        for name, c in counts.items():
            for k, part in enumerate(np.split(c, 16)):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["name", "chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, k, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(body, np.int64)
                sums[name, k] = sums[name, k] + part if (name, k) in sums else part
        for (name, k), c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["name", "chunk", "counts"])

    schema = "name string, chunk int, counts binary"
    known = texts_of(docs.where(F.col(label).isNotNull()), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    rows = known.mapInArrow(count, schema).repartition(16, "name", "chunk").mapInArrow(total, schema).collect()
    names = sorted({r.name for r in rows})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((1 << BITS, len(names)))
    size = (1 << BITS) // 16
    for r in rows:
        counts[r.chunk * size : (r.chunk + 1) * size, names.index(r.name)] = np.frombuffer(r.counts, np.int64)
    counts += 0.1
    return names, np.log(counts / counts.sum(0)) if names else counts


def mixture(n: np.ndarray, lik: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Proportions, and the log likelihood of counts n under rows `lik` of likelihoods by language."""
    p, total = np.full(lik.shape[1], 1 / lik.shape[1]), n.sum()
    for _ in range(rounds):
        q = p * ((n / (lik @ p)) @ lik) / total
        done = np.abs(q - p).max() < 1e-4
        p = q
        if done:
            break
    return p, float(n @ np.log(np.maximum(lik @ p, 1e-300)))


def infer(n: np.ndarray, log_lik: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Proportions of all languages, and the chosen set, largest first."""
    top = log_lik.max(1, keepdims=True)
    lik = np.exp(log_lik - top)
    p, _ = mixture(n, lik)
    order = np.argsort(-p, kind="stable")
    single = n @ np.log(np.maximum(lik, 1e-300))
    chosen, best = [int(np.argmax(single))], float(single.max())
    for k in order:
        if k in chosen or p[k] < 0.02:
            continue
        _, value = mixture(n, lik[:, [*chosen, k]])
        # Neighbouring trigrams share two of three letters, so the evidence counts as a third of it.
        if (value - best) / 3 <= PENALTY * np.log(max(n.sum(), 2)):
            break
        chosen, best = [*chosen, int(k)], value
    own = np.zeros(lik.shape[1])
    own[chosen] = mixture(n, lik[:, chosen])[0] if len(chosen) > 1 else 1.0
    return p, sorted(chosen, key=lambda k: (-own[k], k))


def identify(docs: DataFrame, names: list[str], log_lik: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages): score is the proportion of the predicted language among all, languages the chosen set."""
    sent = docs.sparkSession.sparkContext.broadcast(log_lik)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(2)
            raw, at = text_buffers(texts)
            pred, score, sets = [], [], []
            for i, j in slices(at):
                grams, cut = trigrams(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                for k in range(j - i):
                    own = grams[cut[k] : cut[k + 1]]
                    own = own[own >= 0]
                    if len(own) > 4096:
                        counts = np.bincount(own, minlength=1 << BITS)
                        at_ = np.flatnonzero(counts)
                        n = counts[at_]
                    else:
                        at_, n = np.unique(own, return_counts=True)
                    # Bytes above 127 may be no letters; where there are no others, look closer.
                    part = raw[at[i + k] : at[i + k + 1]]
                    if not names or not len(at_) or (LETTERS[part] < 128).all() and (LETTERS[part] == 32).all():
                        letters = False
                    else:
                        letters = bool(((LETTERS[part] > 32) & (LETTERS[part] < 128)).any()) or any(c.isalpha() for c in texts[i + k].as_py())
                    if not letters:
                        pred.append(UNDETERMINED), score.append(0.0), sets.append([])
                        continue
                    p, chosen = infer(n.astype(float), model[at_])
                    pred.append(names[chosen[0]]), score.append(float(min(1.0, max(0.0, p[chosen[0]])))), sets.append([names[c] for c in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    own = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")


def train_split(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(remainder(3) != 1, F.lit(True))).select("text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, *train(train_split(docs)))
