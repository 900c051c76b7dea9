"""Benchmark decontamination by spaced seeds (native).

Fixed masks pick six of nine adjacent words and ignore the others, so a hash survives substituted words
at the ignored places. Hashes of all places of the benchmark meet those of all places of the documents;
hits on one diagonal (place in the document minus place in the item) that lie close together are an
island. An island counts if at least 80 % of the words agree, over the island or over all of the item
that the document can hold there, and if it has at least MIN_WORDS words or the whole item.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, in lower case.

Defined results: null and empty texts have no words; items of fewer words than a mask spans can't be
found; rows of one doc_id (item_id) count as that document's (item's) texts one by one; rows with null
ids are left out; ties and repeated rows give one row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Places of a window that a seed reads.
MASKS = ((0, 1, 3, 4, 7, 8), (0, 1, 2, 5, 7, 8))
SPAN = 9
GAP = 2 * SPAN
MIN_WORDS = 13
PERCENT = 80
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bounds below which a side is broadcast: bytes of benchmark text, and candidate documents (16 bytes each).
BROADCAST_TEXT = 16 << 20
BROADCAST_ROWS = 1 << 20


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), SEPARATORS), "")


def seeds(words: DataFrame, *keep: str) -> DataFrame:
    """(keep..., place, seed) for each place of `words` and each mask."""
    offsets = sorted({o for m in MASKS for o in m})
    names = {o: f"w{o}" for o in offsets}
    zipped = F.arrays_zip(*(F.slice("words", F.lit(o + 1), F.greatest(F.size("words") - (SPAN - 1), F.lit(0))).alias(names[o]) for o in offsets))
    placed = words.select(*keep, F.posexplode(zipped).alias("place", "z"))
    hashes = F.array(*(F.xxhash64(F.lit(k), *(F.col("z")[names[o]] for o in m)) for k, m in enumerate(MASKS)))
    return placed.select(*keep, "place", F.explode(hashes).alias("seed"))


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_same): overlaps of documents (doc_id, text) with items (item_id, text), in words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of("text").alias("words")).where("doc_id IS NOT NULL")
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    items = items.select("item_id", words_of("text").alias("words"), F.xxhash64("text").alias("item_sign"))
    probes = seeds(items, "item_id", "item_sign").withColumnRenamed("place", "item_place").distinct()
    hits = seeds(docs.withColumn("sign", F.xxhash64("words")), "doc_id", "sign").join(F.broadcast(probes) if size <= BROADCAST_TEXT else probes, "seed")
    key = "doc_id, sign, item_id, item_sign, place - item_place AS diagonal"
    hits = materialize(hits.selectExpr(*key.split(", "), "place").distinct())
    islands = hits.selectExpr("*", f"CASE WHEN place - lag(place) OVER (PARTITION BY doc_id, sign, item_id, item_sign, diagonal ORDER BY place) <= {GAP} THEN 0 ELSE 1 END AS opens")
    islands = islands.selectExpr("*", "sum(opens) OVER (PARTITION BY doc_id, sign, item_id, item_sign, diagonal ORDER BY place) AS island")
    islands = materialize(islands.groupBy("doc_id", "sign", "item_id", "item_sign", "diagonal", "island").agg(F.min("place").alias("lo"), (F.max("place") + SPAN).alias("hi")))
    few = islands.count() <= BROADCAST_ROWS
    ids = islands.select("doc_id").distinct()
    held = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").withColumn("sign", F.xxhash64("words"))
    both = held.join(F.broadcast(islands) if few else islands, ["doc_id", "sign"])
    item_words = items.withColumnRenamed("words", "item_words")
    both = both.join(F.broadcast(item_words) if size <= BROADCAST_TEXT else item_words, ["item_id", "item_sign"])
    start, stop = "greatest(diagonal, 0)", "least(size(words), diagonal + size(item_words))"
    same = "aggregate(zip_with(slice(words, {0} + 1, {1} - {0}), slice(item_words, {0} - diagonal + 1, {1} - {0}), (x, y) -> IF(x = y, 1, 0)), 0, (s, x) -> s + x)"
    counted = both.selectExpr("doc_id", "item_id", "size(item_words) AS item_size", "diagonal", "lo", "hi", f"{start} AS a", f"{stop} AS b", f"{same.format('lo', 'hi')} AS near", f"{same.format(start, stop)} AS all_same")
    counted = counted.selectExpr("*", f"100 * near >= {PERCENT} * (hi - lo) AND hi - lo >= least({MIN_WORDS}, item_size) AS near_ok", f"100 * all_same >= {PERCENT} * (b - a) AND b - a >= least({MIN_WORDS}, item_size) AS all_ok").where("near_ok OR all_ok")
    return counted.selectExpr(
        "doc_id", "item_id", "CAST(IF(all_ok, a, lo) AS BIGINT) AS doc_start", "CAST(IF(all_ok, a, lo) - diagonal AS BIGINT) AS item_start",
        "CAST(IF(all_ok, b - a, hi - lo) AS BIGINT) AS n_words", "CAST(IF(all_ok, all_same, near) AS BIGINT) AS n_same",
    ).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_seed(mask: tuple[int, ...], k: int) -> str:
    return f"SELECT *, '{k}' || " + " || ' ' || ".join(f"words[p + {o + 1}]" for o in mask) + " AS seed FROM {0}"


SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dp AS (SELECT *, unnest(range(0, len(words) - {SPAN - 1})) AS p FROM d),
ip AS (SELECT *, unnest(range(0, len(words) - {SPAN - 1})) AS p FROM i),
ds AS ({' UNION ALL '.join(_sql_seed(m, k).format('dp') for k, m in enumerate(MASKS))}),
es AS ({' UNION ALL '.join(_sql_seed(m, k).format('ip') for k, m in enumerate(MASKS))}),
hits AS (SELECT DISTINCT ds.doc_id, ds.words, es.item_id, es.words AS item_words, ds.p - es.p AS diagonal, ds.p AS place FROM ds JOIN es USING (seed)),
marked AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY doc_id, words, item_id, item_words, diagonal ORDER BY place) <= {GAP} THEN 0 ELSE 1 END AS opens FROM hits),
placed AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, words, item_id, item_words, diagonal ORDER BY place) AS island FROM marked),
islands AS (SELECT doc_id, words, item_id, item_words, diagonal, island, min(place) AS lo, max(place) + {SPAN} AS hi,
  greatest(diagonal, 0) AS a, least(len(words), diagonal + len(item_words)) AS b FROM placed GROUP BY ALL),
counted AS (SELECT *,
  (SELECT count(*) FROM range(lo, hi) AS r(k) WHERE words[k + 1] = item_words[k - diagonal + 1]) AS near,
  (SELECT count(*) FROM range(a, b) AS r(k) WHERE words[k + 1] = item_words[k - diagonal + 1]) AS all_same FROM islands),
judged AS (SELECT *, 100 * near >= {PERCENT} * (hi - lo) AND hi - lo >= least({MIN_WORDS}, len(item_words)) AS near_ok,
  100 * all_same >= {PERCENT} * (b - a) AND b - a >= least({MIN_WORDS}, len(item_words)) AS all_ok FROM counted)
SELECT DISTINCT doc_id, item_id, CAST(CASE WHEN all_ok THEN a ELSE lo END AS BIGINT) AS doc_start, CAST(CASE WHEN all_ok THEN a ELSE lo END - diagonal AS BIGINT) AS item_start,
  CAST(CASE WHEN all_ok THEN b - a ELSE hi - lo END AS BIGINT) AS n_words, CAST(CASE WHEN all_ok THEN all_same ELSE near END AS BIGINT) AS n_same
FROM judged WHERE near_ok OR all_ok
"""
