"""The training-data operators on small tables: odd rows, and brute force where SQL can't express them."""

import collections
import hashlib
import itertools
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sediment.llm import chat, common, decontaminate, jaccard, language, media, mixing, passages, registry, scoring, tokens, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class string, component long"
PROSE = "the quick brown fox jumps over the lazy dog and then it runs back home to sleep until noon"


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, ties, repeated rows, and columns named like results."""
    rows = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, "  \n\t "), (6, "one two"), (7, "ONE\ttwo"), (None, "null id here"), (8, "12 34 !!"), (9, "Éa là çe ñu " * 20), (10, "w " * 30_000), (11, PROSE + " again"), (12, "x" * 200_000)]
    full = [(i, t, "en" if (i or 0) % 2 else None, "s", 0, 0.5, "c", 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_word_kernels():
    texts = ["A b  C", "", "x" * 50, "é\tB\n", "a b c d e f"]
    raw, at = common.text_buffers(pa.array([*texts, None]))
    starts, ends, first = common.word_spans(raw, at)
    got = [[raw[a:b].tobytes().lower() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in itertools.pairwise(first)]
    assert got == [words_of(t) for t in [*texts, None]]
    h = common.word_hashes(raw, starts, ends)
    names = {}
    for word, value in zip(sum(got, []), h.tolist(), strict=True):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 100), (5, 5), (300, 7)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 300: 0, 100: 100, 200: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 1


def test_scoring(spark, odd, empty):
    got = scoring.score_documents(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    seen = collections.Counter(w for i, t in rows if not held(i) for w in [*words_of(t), None])
    n, v = sum(seen.values()), len(seen)
    want = sorted((str(i), held(i), len(words_of(t)) + 1, sum(w in seen for w in [*words_of(t), None]), n, round(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in [*words_of(t), None]), 3)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    assert scoring.score_documents(empty).isEmpty()


def test_scoring_is_a_probability():
    """Bits of all bytes are distributions: over all one-byte words of a class, the spelled probabilities add up to less than 1, and a learned word costs less."""
    sizes = scoring.table_bits(10)
    counts = np.zeros((sum(1 << b for b in sizes), 2), np.uint16)
    words = [b"hello", b"help", b"held"]
    raw, at = scoring.spelled(words)
    z = np.zeros(len(words), np.int64)
    contexts, _ = scoring.byte_contexts(raw, at, z)
    slots, bits = scoring.bit_slots(contexts, raw, sizes)
    for k in range(scoring.PREDICTORS):
        np.add.at(counts, (slots[k], bits), 1)
    model = scoring.new_model(sizes, counts)
    scoring.learn(model, raw, at, z)

    def cost(word):
        raw, at = scoring.spelled([word])
        contexts, before = scoring.byte_contexts(raw, at, np.zeros(1, np.int64))
        slots, bits = scoring.bit_slots(contexts, raw, sizes)
        p = scoring.refined(model, scoring.mixed_odds(model, slots, bits, False)[2], before)
        return float(np.where(bits == 1, p, 1 - p).prod())

    assert sum(cost(bytes([b])) for b in range(256) if b != 32) < 1
    assert cost(b"held") > cost(b"qzxj")


def test_scoring_beats_its_base_on_trained_texts(spark, docs):
    got = scoring.score_documents(docs).where("NOT held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scoring_depends_on_no_layout(spark, docs):
    def scores(df, parts):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            return {r.doc_id: round(r.score, 6) for r in scoring.score_documents(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert scores(docs, "4") == scores(docs.repartition(7), "9")


def test_scoring_classes_are_the_languages_of_all_training_texts(spark, docs):
    """Trigram counts against a brute-force count; a language of one text in thousands is a class; a text's own lang is no input of its score."""
    texts = [("aaa bb " * 3, "x"), ("zzz", "y"), (None, "y"), ("zz aaa", None), ("", "x")]
    got = scoring.fit_classes(spark.createDataFrame(texts * 5, "text string, lang string").repartition(4))
    counts = np.zeros((2, scoring.DIMS))
    for text, lang in texts * 5:
        if text and lang:
            raw = np.frombuffer(text.encode(), np.uint8)
            counts[int(lang == "y")] += scoring.class_counts(raw, np.array([0, len(raw)]))[0]
    share = counts.sum(0) / counts.sum()
    assert np.allclose(np.exp(got).sum(0), 1) and np.allclose(np.exp(got.T), (counts + 20 * share + 0.01) / (counts.sum(1, keepdims=True) + 20 + 0.01 * scoring.DIMS))
    rare = docs.select("text", F.lit("en").alias("lang")).unionByName(spark.createDataFrame([("qxqx wkwk", "rare")], "text string, lang string"))
    model = scoring.fit_classes(rare)
    raw = np.frombuffer(b"qxqx wkwk", np.uint8)
    assert model.shape[1] == 2 and scoring.classify(model, raw, np.array([0, len(raw)]))[0] == 1
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scores = lambda df: {r.doc_id: round(r.score, 6) for r in scoring.score_documents(df).collect()}
    assert scores(docs) == scores(docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))))
    assert all(np.isfinite(v) for v in scores(docs.drop("lang")).values())


def test_scoring_mixes_the_bits_of_running_texts_as_a_plain_scorer_does():
    """Counts, mix and refinement of each bit against dictionaries of whole contexts; texts come back from what is predicted."""
    texts = ["Aa bb  aa\tbb cé", "", " \n", "aa bb", "bb aa aa", "cé " * 30, "zz aa bb"]
    raw, at = common.text_buffers(pa.array(texts))
    spoken, begin = scoring.token_text(raw, at, *common.word_spans(raw, at))
    streams = [spoken[a:b].tobytes() for a, b in itertools.pairwise(begin)]
    assert streams == [b"".join(w + b" " for w in words_of(t)) + b"\n" for t in texts]
    z = np.array([0, 1, 0, 1, 1, 0, 1])
    sizes = (22,) * scoring.PREDICTORS
    model = scoring.new_model(sizes, np.zeros((sum(1 << b for b in sizes), 2), np.uint32))
    for _ in range(3):
        assert scoring.learn(model, spoken, begin, z) == 8 * len(spoken)

    def seen_by(stream, i, kind):
        *words, word = stream[:i].split(b" ")
        last = [bytes(k - min(i, k)) + stream[max(0, i - k) : i] for k in range(1, 5)]
        return [(1, last[0], kind), (2, last[1], kind), (3, last[2], kind), (4, last[3]), (5, word), (6, word, words[-1] if words else None)]

    def bits_of(stream, kind):
        for i, byte in enumerate(stream):
            for place in range(8):
                bit = byte >> (7 - place) & 1
                yield place, bit, stream[i - 1] if i else 0, [(c, place, byte >> (8 - place)) for c in seen_by(stream, i, kind)]

    counts = collections.defaultdict(lambda: [0, 0])
    for stream, kind in zip(streams, z.tolist(), strict=True):
        for _, bit, _, contexts in bits_of(stream, kind):
            for c in contexts:
                counts[c][bit] += 3
    assert np.array_equal(np.sort(model["counts"][model["counts"].any(1)], 0), np.sort(np.array(list(counts.values())), 0))

    def plain(stream, kind):
        total = 0.0
        for place, bit, before, contexts in bits_of(stream, kind):
            pairs = [counts.get(c, (0, 0)) for c in contexts]
            inputs = [*(np.log((b + 0.4) / (a + 0.4)) for a, b in pairs), 0.3]
            level = [sum(sum(p) > least for least in (0, 2, 15)) for p in pairs[-2:]]
            odds = float(np.dot(inputs, model["weights"][(level[0] * 4 + level[1]) * 8 + place]))
            p = 1 / (1 + np.exp(-odds))
            zeros, ones = model["apm"][before * 33 + 16 + int(np.clip(np.rint(odds * 2), -16, 16))]
            p = (p + (ones + 20 * p) / (zeros + ones + 20)) / 2
            total += np.log10(p if bit else 1 - p)
        return total

    new, at = common.text_buffers(pa.array([*texts, "bb cé aa", "new words"]))
    spoken, begin = scoring.token_text(new, at, *common.word_spans(new, at))
    kinds = np.append(z, [0, 1])
    level_base = sum(1 << b for b in sizes[:-2])
    sent = model | {"counts": None, "odds": scoring.log_odds(model["counts"]), "levels": scoring.levels(model["counts"][level_base:]), "level_base": level_base}
    want = [plain(spoken[a:b].tobytes(), k) for (a, b), k in zip(itertools.pairwise(begin), kinds.tolist(), strict=True)]
    for m in (model, sent):
        assert np.allclose(scoring.bit_costs(m, spoken, begin, kinds), want, rtol=1e-4, atol=1e-3)


def test_scoring_in_the_jvm_learns_and_costs_as_the_plain_loops_do(spark, docs):
    """Classes, counts, weights, adaptive table and costs of BitMixer.java against the loops of scoring.py, over steps and groups of texts."""
    some = docs.where("doc_id % 3 = 0").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    some = some.unionByName(spark.createDataFrame([(-1, "xx", ""), (-2, "xx", " Éa là\tX\n"), (-3, None, "w " * 140_000)], "doc_id long, lang string, text string")).cache()
    size = some.agg(F.sum(F.octet_length("text"))).first()[0]
    classes = scoring.fit_classes(some)
    got = scoring.train(some, size, classes)
    rows = some.withColumn("key", F.xxhash64("doc_id", "text")).orderBy("key", "doc_id", "text").collect()
    raw, at = common.text_buffers(pa.array([r.text for r in rows]))
    want, kinds = scoring.new_model(got["sizes"], np.zeros((sum(1 << b for b in got["sizes"]), 2), np.uint32)), []
    groups = [(raw[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in common.slices(at)]
    spoken = [scoring.token_text(own, begin, *common.word_spans(own, begin)) for own, begin in groups]
    for (own, begin), text in zip(groups, spoken, strict=True):
        kinds.append(scoring.classify(classes, common.LOWER[own], begin))
        scoring.learn(want, *text, kinds[-1])
    assert len(groups) > 2 and np.array_equal(got["kinds"], np.bincount(np.concatenate(kinds), minlength=classes.shape[1]))
    assert np.allclose(got["weights"], want["weights"], atol=1e-3) and np.abs(got["apm"] - want["apm"]).sum() <= 1e-3 * want["apm"].sum()
    assert np.array_equal(got["levels"], scoring.levels(want["counts"])[got["level_base"] :]) and np.allclose(got["odds"], scoring.log_odds(want["counts"]), rtol=2e-3, atol=1e-3)
    costs = {r.doc_id: r.cost for r in scoring.mixed_costs(some.withColumn("held_out", F.lit(False)), got, classes).collect()}
    plain = np.concatenate([scoring.bit_costs(got | {"odds": got["odds"].astype(np.float32)}, *text, z) for text, z in zip(spoken, kinds, strict=True)])
    assert np.allclose([costs[r.doc_id] for r in rows], plain, rtol=1e-5, atol=1e-4)


def test_scoring_tells_the_order_of_words(spark):
    """Held-out texts with the same words in another order: the model has seen one order only."""
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = [(k, f"{PROSE} {k % 10}", "en") for k in ids] + [(held[0], PROSE, "en"), (held[1], " ".join(reversed(PROSE.split())), "en")]
    got = {r.doc_id: r for r in scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score) and got[held[0]].score > got[held[1]].score + 3


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_scoring_counts_are_added_in_place_as_pairs(kind):
    """A slot's zeros and ones are one number to learning, and counts are those of each slot and bit."""
    texts = pa.array(["aa bb aa", "bb aa bb cé", "zz " * 300])
    raw, at = common.text_buffers(texts)
    spoken, begin = scoring.token_text(raw, at, *common.word_spans(raw, at))
    sizes, z = scoring.table_bits(10), np.array([0, 1, 0])
    want = np.zeros((sum(1 << b for b in sizes), 2), kind)
    for a in range(0, len(spoken), scoring.STEP_BYTES):
        part = slice(a, a + scoring.STEP_BYTES)
        slots, bits = scoring.bit_slots(scoring.byte_contexts(spoken, begin, z)[0][:, part], spoken[part], sizes)
        for own in slots:
            np.add.at(want, (own, bits), 1)
    model = scoring.new_model(sizes, np.zeros_like(want))
    assert np.shares_memory(scoring.slot_pairs(model["counts"]), model["counts"])
    scoring.learn(model, spoken, begin, z)
    assert np.array_equal(model["counts"], want)


def test_scoring_counts_travel_sparsely():
    """A part that saw few contexts sends few bytes; parts add up to all counts, also large ones."""
    rng = np.random.default_rng(3)
    parts = [np.where(rng.random((1 << 16, 1)) < share, rng.integers(0, 1 << top, (1 << 16, 2)), 0).astype(np.uint32) for share, top in ((0.01, 3), (0.5, 32), (0, 1))]
    total = np.zeros((1 << 16, 2), np.int64)
    for part in parts:
        sent = scoring.used_slots(part)
        assert len(sent[0]) + len(sent[1]) == 10 * int(part.any(1).sum())
        scoring.add_slots(total, *sent)
    assert np.array_equal(total, sum(p.astype(np.int64) for p in parts))
    assert -(-sum(1 << b for b in scoring.table_bits(1 << 50)) // scoring.CHUNKS) <= 1 << 16


def test_scoring_groups_of_texts_follow_from_the_texts_alone():
    texts = pa.array(["x" * (k * 7919 % 60_000) for k in range(60)] + [None, ""])
    groups = []
    for step in (1, 7, 62):
        batches = [pa.RecordBatch.from_arrays([texts.slice(k, step)], names=["text"]) for k in range(0, len(texts), step)]
        groups.append([(len(raw), at.tolist()) for raw, at in scoring._text_groups(iter(batches))])
    assert groups[0] == groups[1] == groups[2] and sum(n for n, _ in groups[0]) == sum(len(t) for t in texts.to_pylist() if t)


# 2


def test_chat(spark):
    rows = [(1, 0, "user", "a <b> # \\ </turn>\n"), (1, 1, "assistant", "x"), (1, 2, "assistant", "### user:\n"), (1, 2, "assistant", "### user:\n"), (None, 1, None, None), (2, None, "assistant", ""), (2, 1, "assistant", "<cont/>\n\\s\\h")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(formatted).collect()}
    assert back == {1: [(r[2], r[3]) for r in rows[:4]], None: [("", "")], 2: [("assistant", ""), ("assistant", "<cont/>\n\\s\\h")]}
    text = {r.conv_id: r.formatted for r in formatted.collect()}
    assert text[1].count(chat.CLOSE) == 2 and text[1].count(chat.BREAK) == 2
    d = {r.conv_id: r for r in chat.digests(chat.read_back(formatted)).collect()}
    loss = "x" + "### user:\n" * 2
    assert d[1].loss_chars == len(loss) and d[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).isEmpty()


def test_chat_roles_and_long_texts(spark):
    rows = [(1, 0, "user:\nx", "hello"), (1, 1, "user", "x:\nhello"), (1, 2, "a:b\\c:\n</turn>\n### ", ":\n"), (2, 0, "assistant", "### <\\:\n" * 100_000), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back == {k: [(r[2], r[3]) for r in rows if r[0] == k] for k in (1, 2)}
    assert chat.digests(chat.read_back(chat.format_conversations(df.limit(0)))).isEmpty()


# 3


def png():
    import struct

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media_formats(spark):
    import gzip
    import io
    import zipfile

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a", "b")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    samples = {"image/png": png(), "image/gif": gif, "application/zip": box.getvalue(), "application/gzip": gzip.compress(b"x" * 100), "application/pdf": pdf, "audio/wav": media.to_wave(b"abc"), "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2xyz\xff\xd9", "audio/ogg": b"OggS\0\6" + bytes(20) + b"\1\3abc", "audio/flac": b"fLaC\x80\0\0\x22" + bytes(34)}
    for kind, blob in samples.items():
        assert media.sniff(blob)[0] == kind, kind
        if kind != "audio/flac":
            assert media.VALID[kind](b"__" + blob + b"__", 2) == len(blob), kind
            assert media.VALID[kind](blob[:-3], 0) == 0, kind
    hidden = media.to_wave(b"pad " + samples["image/png"] + b" pad")
    assert media.sniff(hidden) == ("audio/wav", [(48, len(samples["image/png"]), "image/png")])
    df = spark.createDataFrame([(bytearray(samples["image/png"]), "image/gif"), (bytearray(b"plain"), "text/plain"), (None, None), (bytearray(b""), "x")], "media binary, declared string")
    got = [r.sniffed for r in media.sniff_media(df).collect()]
    assert [(s.type, s.valid, s.corrected) for s in got] == [("image/png", True, True), ("text/plain", False, False), (None, False, False), ("x", False, False)]


def test_media_with_many_signatures_is_fast():
    import time

    began = time.process_time()
    assert media.sniff(b"%PDF-" * 100_000) == (None, [])
    assert media.sniff(b"PK\3\4" * 100_000)[0] is None and time.process_time() - began < 20


def test_media_round_trip(odd, empty):
    got = media.media_features(media.store_texts(odd)).collect()
    texts = sorted((str(r.doc_id), (r.text or "").encode()) for r in odd.collect())
    for r, (i, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(texts, key=lambda x: (x[0], len(x[1]))), strict=True):
        size = max(192, -(-len(t) // 192) * 192)
        payload = t + b" " * (size - len(t))
        assert (str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(t), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wave(payload)).hexdigest() and r.media_bytes == size + 44
    assert media.media_features(media.store_texts(empty)).isEmpty()


# 4


def test_passages(spark, odd, empty):
    passage = " ".join(f"word{k}{'.' if k % 11 == 10 else ''}" for k in range(60)) + "."
    other = " ".join(f"other{k}{'.' if k % 9 == 8 else ''}" for k in range(70))
    near = " ".join(f"long{k}" for k in range(80))
    rows = [(1, passage), (2, f"intro text without end {passage} tail"), (3, other), (4, f"line\n{near}\nend"), (5, near.replace("long40", "changed")), (6, "short repeated line."), (7, "short repeated line.")]
    got = passages.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 4, 5}
    assert {r.doc_id for r in got if r.remove} == {2, 5}
    texts = dict(rows)
    for r in got:
        part = texts[r.doc_id].encode()[r.start : r.stop].decode()
        assert len(part.split()) == r.n_words
    again = {r.doc_id for r in passages.repeated_runs(odd).collect()}
    assert again == {9, 10} and passages.repeated_runs(empty).isEmpty()  # these two repeat within themselves


def test_passages_catch_all_long_repeats(spark, docs):
    got = {r.doc_id for r in passages.repeated_runs(docs).select("doc_id").collect()}
    seen = collections.defaultdict(set)
    for r in docs.select("doc_id", "text").collect():
        w = words_of(r.text)
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(r.doc_id)
    assert {i for s in seen.values() if len(s) > 1 for i in s} <= got


def test_passages_pasted_into_running_text(spark):
    rng = np.random.default_rng(5)

    def prose(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))

    plain, short = prose(51), " ".join(prose(7) + "." for _ in range(8))
    rows = [(2 * k + h, f"{prose(20 + 3 * k + h)} {own} {prose(30 + h)}") for k, own in enumerate((plain, short)) for h in (0, 1)] + [(9, prose(300))]
    got = passages.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3} and {r.doc_id for r in got if r.remove} == {1, 3}
    texts = dict(rows)
    for r in got:
        part = texts[r.doc_id].encode()[r.start : r.stop].decode()
        assert len(part.split()) == r.n_words >= passages.MIN_RUN and any(part in own for own in (plain, short))


def test_passages_within_a_document_and_mixed_runs(spark):
    rng = np.random.default_rng(12)

    def prose(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))

    thrice, head, tail = prose(60), "\n".join(prose(10) for _ in range(2)), "\n".join(prose(10) for _ in range(2))
    # Of document 4's run, the first half is the first of its kind, the second half is a repeat of document 3.
    rows = [(1, "\n".join([prose(9), thrice, prose(9), thrice, thrice])), (3, prose(12) + "\n" + tail), (4, head + "\n" + tail), (5, head + "\n" + prose(9)), (6, "a b a b a b a\n" + prose(20)), (7, "b a b a b a b\n" + prose(20))]
    got = collections.defaultdict(list)
    for r in passages.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.n_words, r.remove))
    assert sorted(got[1]) == [(60, False), (120, True)] or sorted(got[1]) == [(60, False), (60, True), (60, True)]
    assert sorted(got[4]) == [(20, False), (20, True)] and set(got) == {1, 4}


def test_paragraph_clusters_equal_exact_ones(spark):
    """Clusters of paragraphs against exact Jaccard over all pairs, also where buckets are crowded and sets are small."""
    rng = np.random.default_rng(13)
    base = [[f"w{x}" for x in rng.integers(0, 10**5, n)] for n in (5, 6, 7, 8, 20, 60, 60)]
    texts = ["a b a b a b", "b a b a b a", "a b a b a b a", "x x x x x", "x x x x x x x"]
    for words in base:
        for edits in (0, 1, 1, 2, 3, 4, 5):
            own = list(words)
            for at in rng.integers(0, len(own), edits if len(own) > 8 else edits // 3):
                own[at] = f"e{rng.integers(0, 10**5)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = common.materialize(passages.occurrences(docs))
    clusters = {r["class"]: r.cluster for r in passages.paragraph_clusters(docs, found, 4).collect()}
    place = collections.defaultdict(set)
    for r in found.collect():
        if r["class"] in clusters:
            place[clusters[r["class"]]].add(r.doc_id)
    want = collections.defaultdict(set)
    for i, (_, top) in brute_components(list(enumerate(texts))).items():
        want[top].add(i)
    assert sorted(map(sorted, place.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


# 5


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * len(sets[a] | sets[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(s), top(i)) for i, s in sets.items()}


def brute_links(rows):
    """How many other rows each document links with."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} - {()} for i, w in ((i, words_of(t)) for i, t in rows)}
    out = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            out[a] += 1
            out[b] += 1
    return out


def near_copies(seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for size in (5, 6, 9, 12, 30, 64, 150, 400):
        for _ in range(2):
            base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                own = list(base)
                for _ in range(edits if size > 20 else min(edits, 1)):
                    at = int(rng.integers(0, len(own)))
                    if rng.random() < 0.3:
                        own = own[: max(1, len(own) - 1)]
                    else:
                        own[min(at, len(own) - 1)] = f"e{rng.integers(0, 10**6)}"
                rows.append((k, " ".join(own)))
                k += 1
    return rows


@pytest.mark.parametrize("small", [1, 8])
def test_jaccard_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = near_copies(small)
    got = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), count=True).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert {r.doc_id: r.n_links for r in got} == brute_links(rows)


def boilerplate(seed, n_docs):
    """Unlike documents around a shared shingle or passage, groups of near copies, and chains of links that pass through hot buckets."""
    rng = np.random.default_rng(seed)

    def prose(n):
        return [f"w{x}" for x in rng.integers(0, 10**6, n)]

    line, license_text, base = prose(5), prose(60), prose(100)
    rows = []
    for k in range(n_docs):
        kind = k % 4
        if kind == 0:
            own = prose(20) + line + prose(20)
        elif kind == 1:
            own = license_text + prose(int(rng.integers(0, 16)))
        elif kind == 2:
            own = list(base)
            own[int(rng.integers(4, 96))] = f"e{k}"
        else:
            own = base[: 100 - k % 30] + prose(k % 9)
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize(("small", "block", "columns"), [(1, 1 << 10, 1 << 12), (8, 5, 16)])
def test_jaccard_hot_buckets_equal_brute_force(spark, monkeypatch, small, block, columns):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rows = boilerplate(small, 240)
    rows += [(1000 + i, t) for i, t in rows[::3]]  # copies count as links
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    got = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), count=True).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert {r.doc_id: r.n_links for r in got} == brute_links(rows)


@pytest.mark.parametrize("columns", [3, 1 << 12])
def test_cells_count_all_links(monkeypatch, columns):
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rng = np.random.default_rng(columns)
    sets = [sorted({*range(30)} - {*rng.integers(0, 30, 4).tolist()} | {*rng.integers(100, 10**6, k % 4).tolist()}) for k in range(40)]
    copies = rng.integers(1, 5, 40)
    link = np.array([[a is not b and 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b}) for b in sets] for a in sets])
    for lo, hi in ((2, 2), (2, 5)):
        block = np.full(40, 2) if lo == hi else rng.choice([2, 5], 40)
        cell = pa.table({"lo": [lo] * 40, "hi": [hi] * 40, "block": block, "class": range(40), "copies": copies, "hashes": pa.array(sets, pa.list_(pa.int64()))})
        got = dict(zip(*(c.to_pylist() for c in jaccard.cell_links(cell).columns), strict=True))
        across = np.ones((40, 40), bool) if lo == hi else block[:, None] != block
        assert got == dict(enumerate(((link & across) @ copies).tolist()))
    alone = cell.filter(pa.array(block == 5))
    assert set(jaccard.cell_links(alone)["n"].to_pylist()) == {0}


def test_jaccard_one_shingle_in_thousands_of_documents(spark):
    """Thousands of unlike documents that share a shingle stay apart, and no bucket is expanded into all their pairs."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join([f"w{x}" for x in rng.integers(0, 10**7, 12)] + ["all", "rights", "are", "reserved", "here"])) for k in range(3000)]
    got = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), count=True).collect()
    assert len(got) == 3000 and all(r.component_id == r.doc_id and r.n_links == 0 for r in got)


def test_jaccard_parts_in_pieces(monkeypatch):
    """A part read in small pieces gives the same small pairs, and hot keys' members, as one read at once."""
    rng = np.random.default_rng(9)
    key, owner = rng.integers(0, 300, 4000) % rng.integers(1, 300, 4000) << 40, rng.integers(0, 500, 4000)
    rows = np.unique(np.stack([key, owner], 1), axis=0)
    rng.shuffle(rows)
    results = []
    for size, step in ((1 << 30, 4000), (200, 37)):
        monkeypatch.setattr(jaccard, "PIECE_BYTES", size)
        dealt = []
        for at in range(0, len(rows), step):
            jaccard.deal_keys(dealt, rows[at : at + step, 0].copy(), rows[at : at + step, 1].copy(), 1)
        out = pa.Table.from_batches(list(jaccard._bucket(iter([jaccard.dealt_batch(dealt)])))).to_pylist()
        results.append({k: {(r["a"], r["b"]) for r in out if r["kind"] == k} for k in (1, 2)})
    assert results[0] == results[1] and all(results[0].values())


def test_sketch_distance_bounds_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 10, 200, 2000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 7, dtype=np.uint64)])
        far = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
        assert far <= len(np.setxor1d(a, b)) and (n == 1 or far > 0)


def test_jaccard_signatures_lose_no_link():
    """Any two sets with a similarity of 0.8 share a key in some band, or are both bound."""
    rng = np.random.default_rng(1)
    for n in (*range(1, 40), 100, 255, 256, 257, 700, 1500):
        for _ in range(6):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            out = int(rng.integers(0, n // 5 + 1))
            b = np.concatenate([a[out:], rng.integers(0, 2**63, max(0, int((n - out) / 0.8) - n), dtype=np.uint64)])
            if not len(b) or len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
                continue
            keys = [{(band, int(k)) for band, own, _, _ in jaccard.signatures(np.sort(x)) for k in own} for x in (a, b)]
            assert keys[0] & keys[1], n


def test_jaccard_odd_rows(odd, empty):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_documents(odd).collect())
    want = brute_components([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    assert sorted(set(got)) == sorted((i, *x) for i, x in want.items()) and len(got) == odd.where("doc_id IS NOT NULL").count()
    assert jaccard.link_documents(empty, count=True).isEmpty()
    counted = {r.doc_id: r.n_links for r in jaccard.link_documents(odd, count=True).collect()}
    assert (counted[1], counted[2], counted[4], counted[6]) == (3, 3, 0, 1)  # repeated rows count, and a near copy


# 6


def test_repair_round_trip():
    rng = np.random.default_rng(2)
    for n, kinds in ((1, 5), (50, 2), (5000, 3), (20_000, 40)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, n + 1, 5), n))
        symbols, rules, per = tokens.repair(ids, ends, kinds)
        assert per.sum() == len(symbols) and (tokens.expand(symbols, rules, kinds) == ids).all()
        lengths = tokens.rule_lengths(rules, kinds)
        assert all(len(tokens.expand(np.array([kinds + k]), rules, kinds)) == x for k, x in enumerate(lengths))
        at = np.cumsum(per)
        assert [len(tokens.expand(symbols[a - p : a], rules, kinds)) for a, p in zip(at, per, strict=True)] == np.diff(ends, prepend=0).tolist()
    assert len(tokens.repair(np.zeros(5000, np.uint32), np.array([5000]), 1)[0]) < 20


@pytest.mark.parametrize("least", [2, tokens.LEAST])
def test_repair_goes_on_to_the_end(least):
    """No pair within a document occurs `least` times (without overlaps) in the end, and the first rule is the most frequent pair."""
    rng = np.random.default_rng(least)
    passage = rng.integers(0, 1000, 60)
    ids = np.concatenate([x for _ in range(40) for x in (rng.zipf(1.3, 50) % 50, passage, np.full(rng.integers(0, 9), 7))]).astype(np.uint32)
    ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 12), len(ids)))
    symbols, rules, per = tokens.repair(ids, ends, 1000, least)
    assert (tokens.expand(symbols, rules, 1000) == ids).all()
    often, at = collections.Counter(), 0
    for p in per:
        own, last = symbols[at : at + p].tolist(), None
        for k, pair in enumerate(itertools.pairwise(own)):
            if pair != last:
                often[pair] += 1
                last = pair if pair[0] == pair[1] else None
            else:
                last = None
        at += p
    assert max(often.values()) < least
    assert len(symbols) < len(ids) / 2.5


def test_repair_sorts_no_more_than_the_pairs_that_count(monkeypatch):
    """Sorting every pair of every round took half of the time of a block."""
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 3000, rng.integers(2, 6)) for _ in range(2000)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.2, 60_000) % 2000]).astype(np.uint32)
    ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 50), len(ids)))
    sizes, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **own: sizes.append(len(x)) or unique(x, **own))
    symbols, rules, _ = tokens.repair(ids, ends, 3000)
    assert (tokens.expand(symbols, rules, 3000) == ids).all() and len(symbols) < len(ids) / 2
    assert max(sizes, default=0) < len(ids) / 8


def test_expand_of_nested_and_of_seldom_used_rules():
    """Rules that are longer together than what is expanded, and a few that stand for nearly all of it."""
    nested = np.array([[0, 1], *([k + 10, k + 10] for k in range(11))])
    lengths = tokens.rule_lengths(nested, 10)
    assert lengths.tolist() == [2 << k for k in range(12)] and tokens.rule_lengths(nested[:0], 10).tolist() == []
    for symbols in ([12, 3, 10], [21] * 9 + [4, 11], [5], []):
        want = [i for x in symbols for i in ([x] if x < 10 else [0, 1] * (1 << (x - 10)))]
        assert tokens.expand(np.array(symbols, np.int64), nested, 10).tolist() == want


def test_pieces_are_added_to_the_cache_in_place(monkeypatch):
    """A slice with new words doesn't copy what is known, and ids are the same when the cache grows, and when it is emptied."""
    path = tokens.default_path()
    words = ["".join(chr(97 + int(d)) for d in str(k)) + "!," * (k % 2) for k in range(60_000)]
    texts = pa.array([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
    grown, emptied = tokens.WordEncoder(path), tokens.WordEncoder(path)
    want = grown.encode(texts)
    before = grown.keys
    grown.encode(pa.array(["zzzz zzzx"]))
    assert grown.keys is before
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5000)
    for k in range(0, len(texts), 10):
        ids, n = emptied.encode(texts.slice(k, 10))
        a = int(want[1][:k].sum())
        assert np.array_equal(n, want[1][k : k + 10]) and np.array_equal(ids, want[0][a : a + len(ids)])


def test_words_equal_the_library_on_random_strings():
    from tokenizers import Tokenizer

    path = tokens.default_path()
    whole, own = Tokenizer.from_file(path), tokens.WordEncoder(path)
    rng = np.random.default_rng(6)
    letters = [*"aAbzZ.,!?;:'’\"-<|>()0159 \n\t\r\x0b\x0c", "İ", "ı", "ſ", "ß", "ŉ", "é", "e\u0301", "\u0307", "ﬁ", "Σ", "ς", "क़", "ा", "日", "한", "\u1100\u1161", "\xa0", "\u2009", "\x85", "\x1c", "\ufeff", "😀", "</w>", "<|endoftext|>", "'s", "n't"]
    texts = ["".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(1, 14))) for _ in range(6000)] + ["İ; İ, İ: x", None, ""]
    ids, n = own.encode(pa.array(texts))
    for t, a, b in zip(texts, np.cumsum(n) - n, np.cumsum(n), strict=True):
        assert ids[a:b].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, tokens.END_ID], t


def test_token_shards(spark, odd, empty, docs):
    from tokenizers import Tokenizer

    path = tokens.default_path()
    whole = Tokenizer.from_file(path)
    for table in (odd, docs):
        rows = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, at = [], 0
        for i, t in rows:
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
            want.append((str(i), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        shards = tokens.encode_shards(table, path)
        assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in tokens.document_ids(shards).collect()) == sorted(want)
    block = shards.first()
    n = np.frombuffer(block.n_tokens, np.uint32)
    for doc in (0, len(n) // 2, len(n) - 1):
        all_ids = tokens.read_range(block, doc, 0, int(n[doc]))
        assert all_ids[-1] == tokens.END_ID and (tokens.read_range(block, doc, 1, int(n[doc]) - 1) == all_ids[1:-1]).all()
    assert tokens.document_ids(tokens.encode_shards(empty, path)).isEmpty()


def test_words_equal_whole_texts():
    from tokenizers import Tokenizer

    path = tokens.default_path()
    whole, own = Tokenizer.from_file(path), tokens.WordEncoder(path)
    texts = ["don't stop, it's fine.", "İstanbul ß ﬁ é 1234 a1b2", "<|endoftext|> <|startoftext|>x", " x y\x1cz\x85", "a.b,c! ... ?!", "日本語 テスト", "\r\n\t", "ΣΑΣ ΟΔΟΣ"]
    ids, n = own.encode(pa.array(texts))
    for t, a, b in zip(texts, np.cumsum(n) - n, np.cumsum(n), strict=True):
        assert ids[a : b - 1].tolist() == whole.encode(t, add_special_tokens=False).ids and ids[b - 1] == tokens.END_ID, t


# 7


def test_language(spark, docs, odd, empty):
    got = language.identify(docs, *language.train(language.train_split(docs))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    rows = {str(r.doc_id): r for r in language.identify(odd, *language.train(language.train_split(odd))).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {"3", "4", "5", "8"}
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {r.lang_pred for r in language.identify(odd, *language.train(odd.limit(0).select("text", "lang"))).collect()} == {"und"}
    assert language.identify(empty, *language.train(language.train_split(docs))).isEmpty()


def test_mixture():
    lik = np.array([[0.9, 0.1], [0.1, 0.9]])
    p, _ = language.mixture(np.array([70.0, 30.0]), lik)
    assert abs(p[0] - 0.75) < 0.01
    assert language.infer(np.array([1000.0, 10.0]), np.log(lik))[1][0] == 0
    assert language.infer(np.array([3000.0, 3000.0]), np.log(lik))[1] in ([0, 1], [1, 0])


def test_mixture_sets_equal_the_best_of_all_subsets():
    """The chosen languages against every subset's penalised likelihood."""
    rng = np.random.default_rng(7)
    for shares in ((1, 0, 0, 0), (0.5, 0.5, 0, 0), (0.2, 0, 0.8, 0), (0.4, 0.3, 0.3, 0), (0, 0, 0.05, 0.95), (0.25, 0.25, 0.25, 0.25)):
        lik = rng.dirichlet(np.full(300, 0.3), 4).T + 1e-5
        lik /= lik.sum(0)
        n = rng.multinomial(3000, lik @ np.array(shares)).astype(float)
        seen = n > 0
        values = {}
        for k in range(1, 5):
            for own in itertools.combinations(range(4), k):
                values[own] = language.mixture(n[seen], lik[seen][:, own], 500)[1] / 3 - language.PENALTY * np.log(n.sum()) * k
        p, chosen = language.infer(n[seen], np.log(lik[seen]))
        assert tuple(sorted(chosen)) == max(values, key=values.get)
        assert np.abs(p - np.array(shares)).max() < 0.05


# 8


def brute_raking(rows, targets, dims, rounds=400):
    """Weights of rows by repeated scaling, one row and one dimension at a time."""
    weight, total = [1.0] * len(rows), sum(r["n"] for r in rows)
    for _ in range(rounds):
        for d in dims:
            mass = collections.Counter()
            for r, w in zip(rows, weight, strict=True):
                mass[r[d]] += w * r["n"]
            weight = [w * targets[d][r[d]] * total / mass[r[d]] for r, w in zip(rows, weight, strict=True)]
    return weight


def test_raking_equals_brute_force(spark):
    rng = np.random.default_rng(14)
    rows = [{"id": k, "source": f"s{rng.integers(0, 3)}", "lang": ["en", "de"][rng.integers(0, 2)], "topic": f"t{rng.integers(0, 4)}", "n": int(rng.integers(1, 90))} for k in range(300)]
    dims = ("source", "lang", "topic")
    targets = {}
    for d in dims:
        mass = collections.Counter()
        for r in rows:
            mass[r[d]] += r["n"]
        flat = {v: (m / sum(mass.values())) ** mixing.FLATTEN for v, m in mass.items()}
        targets[d] = {v: x / sum(flat.values()) for v, x in flat.items()}
    targets["source"] = {"s0": 0.6, "s1": 0.3, "s2": 0.1}
    want = brute_raking(rows, targets, dims)
    df = spark.createDataFrame([(r["id"], r["source"], r["lang"], r["topic"], r["n"]) for r in rows], "doc_id long, source string, lang string, topic string, n_tokens long")
    got = {r.doc_id: r for r in mixing.sample(df, mixing.cell_weights(df, {"source": targets["source"]})).collect()}
    assert all(abs(got[r["id"]].token_weight - w) < 1e-5 * w for r, w in zip(rows, want, strict=True))
    scale = mixing.RATE * sum(r["n"] for r in rows) / sum(r["n"] * w for r, w in zip(rows, want, strict=True))
    assert all(abs(got[r["id"]].probability * got[r["id"]].weight - w * scale) < 1e-5 for r, w in zip(rows, want, strict=True))


# 8


def test_raking(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"s{rng.integers(0, 4)}", ["en", "de", None][rng.integers(0, 3)], f"t{rng.integers(0, 3)}", int(rng.integers(1, 50)), "kept") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long, weight string").cache()
    targets = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, "lang": {"en": 0.5, None: 0.2}}
    results = []
    for bound in (10**6, 0):
        weights = mixing.cell_weights(df, targets, max_cells=bound)
        got = mixing.sample(df, weights).collect()
        results.append({r.doc_id: (round(r.token_weight, 6), round(r.probability, 6), r.keep) for r in got})
        total = sum(r.token_weight * r.n_tokens for r in got)
        for d in ("source", "lang"):
            for value, share in targets[d].items():
                assert abs(sum(r.token_weight * r.n_tokens for r in got if r[d] == value) / total - share) < 1e-4
        expected = sum(r.probability * r.weight * r.n_tokens for r in got)
        assert abs(expected / sum(r.n_tokens for r in got) - mixing.RATE) < 1e-6
        assert abs(sum(r.keep for r in got) - sum(r.probability for r in got)) < 40
    assert results[0] == results[1]


def test_mixing_odd_rows(odd, empty):
    described = mixing.described(odd)
    got = mixing.sample(described, mixing.cell_weights(described)).collect()
    assert len(got) == odd.count() and not any(r.keep for r in got if not words_of(r.text))
    nothing = mixing.described(empty)
    assert mixing.sample(nothing, mixing.cell_weights(nothing)).isEmpty()


def test_mixed_sources_meet_their_targets(spark):
    import corpus_pipeline as cp

    rows = [(k, "seven words make up this short text", "en", "rare" if k % 50 == 0 else "hot", 35) for k in range(4000)]
    got = [r.source for r in cp.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()]
    target = mixing.target_shares({"rare": 80.0, "hot": 3920.0}, None)["rare"]
    assert mixing.RATE * target * 4000 > 80 and abs(got.count("rare") / len(got) - target) < 0.008


# 9


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(6)
    emit, move, start = rng.normal(size=5), rng.normal(size=(2, 2)), -0.3
    begins = np.array([True, False, False, True, False])
    p, pair = toxicity.marginals(emit, begins, move, start)
    for lo, hi in ((0, 3), (3, 5)):
        total, ones, both = 0.0, np.zeros(hi - lo), 0.0
        for y in itertools.product((0, 1), repeat=hi - lo):
            s = np.exp(start * y[0] + sum(emit[lo + k] * v for k, v in enumerate(y)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
            total, ones, both = total + s, ones + s * np.array(y), both + s * y[0] * y[1]
        assert np.allclose(p[lo:hi], ones / total) and np.isclose(pair[lo + 1, 1, 1], both / total)


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for k in range(400):
        w = [f"word{x}" for x in rng.integers(0, 50, 40)]
        bad = k % 4 == 0
        if bad:
            for at in rng.integers(0, 40, 3):
                w[at] = ["Scoundrel,", "villain", "rascal!"][rng.integers(0, 3)]
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(docs, marks))
    got = toxicity.score(docs, model).collect()
    truth = dict(labels)
    assert all(r.predicted == truth[r.doc_id] for r in got if r.held_out) and sum(r.held_out for r in got) > 40
    texts = dict(rows)
    found = {re.sub(r"\W", "", texts[r.doc_id].encode()[s.start : s.end].decode().split()[0]).lower() for r in got for s in r.spans}
    assert found == {"scoundrel", "villain", "rascal"}
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert {r.score for r in toxicity.score(odd, toxicity.train(toxicity.training_rows(odd, marks.limit(0)))).collect()} == {0.0}
    assert toxicity.score(empty, model).isEmpty()


# 10


def test_decontamination(spark, odd, empty):
    item = " ".join(f"q{k}" for k in range(30))
    changed = item.split()
    changed[4] = changed[13] = changed[22] = "zz"
    short = "alpha beta gamma delta"
    bench = spark.createDataFrame([(1, item), (1, item), (2, short), (3, None), (None, item), (4, "")], "item_id long, text string")
    rows = [(1, f"before it {item} after it"), (2, " ".join(changed)), (3, " ".join(reversed(item.split()))), (4, " ".join(item.split()[:8])), (5, f"x {short} y"), (6, None), (7, ", ".join(item.upper().split())), (None, item)]
    got = decontaminate.contaminated(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.doc_start, r.n_words, r.n_same) for r in got) == [(1, 1, 2, 30, 30), (2, 1, 0, 30, 27), (7, 1, 0, 30, 30)]
    assert decontaminate.contaminated(odd, bench).isEmpty() and decontaminate.contaminated(empty, bench).isEmpty() and decontaminate.contaminated(odd, bench.limit(0)).isEmpty()


def test_decontamination_recall(spark):
    """Found pairs against all alignments: an overlap of 80 % over the whole item, with substituted words at random places."""
    rng = np.random.default_rng(15)
    items = [[f"w{x}" for x in rng.integers(0, 10**6, 30)] for _ in range(40)]
    rows = []
    for k in range(400):
        own = list(items[k % 40])
        for at in rng.choice(30, k // 40 % 9, replace=False):
            own[at] = f"e{rng.integers(0, 10**6)}"
        head = int(rng.integers(0, 20))
        rows.append((k, " ".join([f"p{x}" for x in rng.integers(0, 10**6, head)] + own + [f"p{x}" for x in rng.integers(0, 10**6, 9)])))
    want = set()
    for k, text in rows:
        w = text.split()
        want |= {(k, i) for i, item in enumerate(items) if any(sum(a == b for a, b in zip(w[at : at + 30], item, strict=True)) >= 24 for at in range(len(w) - 29))}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(want) > 250 and len(want & got) >= 0.97 * len(want)
    # Beyond the whole item, only runs of at least MIN_WORDS words of which 80 % agree are found.
    for k, i in got - want:
        w, item = rows[k][1].split(), items[i]
        assert any(sum(a == b for a, b in zip(w[d + lo : d + hi], item[lo:hi], strict=True)) >= 0.8 * (hi - lo) for d in range(len(w) - 29) for lo in range(18) for hi in range(lo + 13, 31))


# SQL, and the pipeline


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, got[columns].astype(object).values.tolist())) == sorted(map(repr, want[columns].astype(object).values.tolist()))


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    kept = docs.select(*cp.COLUMNS)
    before = {r.doc_id: r.text for r in kept.collect()}
    steps = []
    for _, stage in cp.STAGES[:3]:
        kept = common.materialize(stage(spark, kept, SF))
        assert kept.columns == list(cp.COLUMNS)
        steps.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert steps[0] == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}
    groups = brute_components([(i, before[i]) for i in sorted(steps[0])])
    assert steps[1] == {i for i, (_, c) in groups.items() if c == i}
    leaked = {r.doc_id for r in decontaminate.contaminated(docs, common.table(spark, SF, "benchmark")).collect()}
    assert steps[2] == steps[1] - leaked
    mixed = common.materialize(cp.STAGES[3][1](spark, kept, SF))
    assert 0 < mixed.count() < kept.count() and mixed.columns == list(cp.COLUMNS)
    last = cp.STAGES[4][1](spark, mixed, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in mixed.select("doc_id").collect()) and last[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(last))


def test_pipeline_odd_rows(spark, odd, empty):
    """Stages judge rows by doc_id and text: null ids, repeated rows, and one doc_id with several texts."""
    import corpus_pipeline as cp

    other = "un texte bien différent de tous les autres qui se trouvent dans cette table et qui reste donc seul"
    more = spark.createDataFrame([(1, other, "fr", "s", 0), (None, PROSE, "en", "s", 0), (20, None, None, None, None), (None, other + " encore une fois", "fr", "s", 0)], odd.select(*cp.COLUMNS).schema)
    docs = common.materialize(odd.select(*cp.COLUMNS).unionByName(more))
    with_language = common.materialize(cp.identify_language(spark, docs, SF))
    text = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    assert text(with_language) == sorted((str(r.doc_id), r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    alone = common.materialize(cp.drop_near_duplicates(spark, with_language, SF))
    kept = [(i, t) for i, t in text(alone)]
    assert kept.count(("1", PROSE)) == 1 and [i for i, t in kept if words_of(t) == words_of(PROSE)] == ["1"]
    assert ("1", other) in kept and ("None", "null id here") in kept and sum(words_of(t) == words_of("one two") for _, t in kept) == 1
    clean = common.materialize(cp.drop_contaminated(spark, alone, SF))
    assert text(clean) == kept
    stage = docs.where("false")
    for _, step in cp.STAGES:
        stage = step(spark, stage, SF)
    assert stage.isEmpty()
