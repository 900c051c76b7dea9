"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

The weight of a cell (source, language, topic) is a product of one factor for each marginal. Each step
scales the factors of one marginal so that the weighted tokens meet its target shares; steps alternate
until all marginals hold. A document of weight w (times a constant) is sampled with probability
min(1, w) and counts w / min(1, w) times, so expected tokens meet the targets; the draw is a hash of doc_id.

Cells are aggregated by Spark. Up to MAX_CELLS of them are raked on the driver (a bound of some tens of MB);
more are raked by joins and sums of DataFrames, with the same result.

Defined results: a null source, language or topic is a value of its own; target values that don't occur
are left out and the rest scaled to 1, and values without a target keep their observed share of what is left (none if the
targets sum to 1 or more); cells without tokens get weight 0; null texts have no tokens, are never drawn;
targets that can't hold together are met as closely as the last round left them; a null doc_id is drawn
as one id; repeated rows are drawn together; an empty table gives no rows; other columns are kept, those
with the names of results replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

DIMENSIONS = ("source", "lang", "topic")
MAX_CELLS = 200_000
ROUNDS = 100
TOLERANCE = 1e-9
#: Share of the tokens to keep, and the exponent that flattens observed shares into default targets.
RATE, FLATTEN = 0.5, 0.7
WORDS = r"[^\x20\x09-\x0D]+"


def token_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORDS)), F.lit(0)).cast("long")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The table has no topics; this stands in for them: the kind of text, by its shape alone."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(text.isNull() | (n_tokens == 0), "empty").when(bars * 5 > n_tokens, "table").when(n_tokens < 100, "note").when(n_tokens < 500, "article").otherwise("book")


def key_of(name: str) -> Column:
    """A dimension as a string in which null differs from every value."""
    c = F.col(name).cast("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), c)).alias(f"__{name}")


def target_shares(observed: dict[str, float], wanted: dict[str | None, float] | None) -> dict[str, float]:
    """Shares by key: the wanted ones, or observed ones flattened and scaled."""
    total = sum(observed.values())
    if not total:
        return {}
    if wanted is None:
        flat = {k: (v / total) ** FLATTEN if v else 0.0 for k, v in observed.items()}
    else:
        named = {("null" if k is None else f"={k}"): float(v) for k, v in wanted.items()}
        rest = sum(v for k, v in observed.items() if k not in named)
        left = max(0.0, 1.0 - sum(named.values()))
        flat = {k: named[k] if k in named else (left * v / rest if rest else 0.0) for k, v in observed.items()}
        flat = {k: v if observed[k] else 0.0 for k, v in flat.items()}
    scale = sum(flat.values())
    return {k: v / scale for k, v in flat.items()} if scale else {}


def rake_arrays(codes: list[np.ndarray], tokens: np.ndarray, shares: list[np.ndarray]) -> np.ndarray:
    """Weights of cells: codes[d] holds each cell's value of dimension d, shares[d] the target share of each value."""
    weight, total = np.ones(len(tokens)), tokens.sum()
    for _ in range(ROUNDS):
        worst = 0.0
        for code, share in zip(codes, shares, strict=True):
            mass = np.bincount(code, weight * tokens, minlength=len(share))
            factor = np.divide(share * total, mass, out=np.zeros(len(share)), where=mass > 0)
            worst = max(worst, float(np.abs(mass / total - share)[mass > 0].max(initial=0.0)))
            weight = weight * factor[code]
        if worst < TOLERANCE:
            break
    return weight


def rake_frames(cells: DataFrame, keys: list[str], shares: list[DataFrame], total: float) -> DataFrame:
    """The same by joins and sums, for any number of cells: (keys..., tokens, weight); shares[d]: (key, share)."""
    cells = cells.withColumn("weight", F.lit(1.0))
    for _ in range(ROUNDS):
        worst = 0.0
        for key, share in zip(keys, shares, strict=True):
            mass = cells.groupBy(key).agg(F.sum(F.col("weight") * F.col("tokens")).alias("mass"))
            factor = materialize(mass.join(share, key, "left").select(key, "mass", F.coalesce("share", F.lit(0.0)).alias("share")))
            gap = factor.where("mass > 0").agg(F.max(F.abs(F.col("mass") / total - F.col("share")))).first()[0]
            worst = max(worst, gap or 0.0)
            step = factor.select(key, F.expr(f"CASE WHEN mass > 0 THEN share * {total!r}D / mass ELSE 0D END").alias("factor"))
            cells = materialize(cells.join(step, key).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"))
        if worst < TOLERANCE:
            break
    return cells


def cell_weights(docs: DataFrame, targets: dict[str, dict | None] | None = None, dimensions: tuple[str, ...] = DIMENSIONS, tokens: str = "n_tokens", rate: float = RATE, max_cells: int = MAX_CELLS) -> DataFrame:
    """(__dimension..., token_weight, expected): raked weights of all cells, and how often a document of the cell is expected in the sample."""
    spark, targets = docs.sparkSession, targets or {}
    keys = [f"__{d}" for d in dimensions]
    cells = materialize(docs.groupBy(*(key_of(d) for d in dimensions)).agg(F.sum(tokens).alias("tokens")))
    schema = ", ".join(f"{k} string" for k in keys) + ", token_weight double, expected double"
    if cells.count() <= max_cells:
        rows = sorted(cells.collect())
        mass = np.array([r.tokens for r in rows], float)
        if not mass.sum():
            return spark.createDataFrame([(*r[: len(keys)], 0.0, 0.0) for r in rows], schema)
        codes, shares = [], []
        for k, d in enumerate(dimensions):
            values, code = np.unique([r[k] for r in rows], return_inverse=True)
            observed = dict(zip(values.tolist(), np.bincount(code, mass), strict=True))
            share = target_shares(observed, targets.get(d))
            codes.append(code)
            shares.append(np.array([share.get(v, 0.0) for v in values.tolist()]))
        weight = rake_arrays(codes, mass, shares)
        scale = rate * mass.sum() / max((weight * mass).sum(), 1e-300)
        return spark.createDataFrame([(*r[: len(keys)], float(w), float(w * scale)) for r, w in zip(rows, weight, strict=True)], schema)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    shares = []
    for d, key in zip(dimensions, keys, strict=True):
        sums = {r[0]: float(r[1]) for r in cells.groupBy(key).agg(F.sum("tokens")).collect()} if targets.get(d) is not None else None
        if sums is not None:
            shares.append(spark.createDataFrame(list(target_shares(sums, targets[d]).items()) or [("", 0.0)], f"{key} string, share double"))
        else:
            flat = cells.groupBy(key).agg(F.sum("tokens").alias("t")).select(key, F.when(F.col("t") > 0, F.pow(F.col("t") / max(total, 1.0), F.lit(FLATTEN))).otherwise(0.0).alias("share"))
            scale = flat.agg(F.sum("share")).first()[0] or 1.0
            shares.append(materialize(flat.withColumn("share", F.col("share") / scale)))
    raked = rake_frames(cells, keys, shares, total)
    mass = raked.agg(F.sum(F.col("weight") * F.col("tokens"))).first()[0] or 1.0
    return raked.select(*keys, F.col("weight").alias("token_weight"), (F.col("weight") * (rate * total / mass)).alias("expected"))


def draw() -> Column:
    """A uniform number in [0, 1) of each doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample(docs: DataFrame, weights: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, tokens: str = "n_tokens") -> DataFrame:
    """docs with token_weight, probability, weight (how often a drawn document counts) and keep."""
    keys = [f"__{d}" for d in dimensions]
    docs = docs.drop("token_weight", "expected", "probability", "weight", "keep", *keys)
    keyed = docs.select("*", *(key_of(d) for d in dimensions))
    few = weights.count() <= MAX_CELLS
    joined = keyed.join(F.broadcast(weights) if few else weights, keys, "left").drop(*keys)
    expected = F.when(F.col(tokens) > 0, F.coalesce("expected", F.lit(0.0))).otherwise(0.0)
    return joined.withColumn("probability", F.least(F.lit(1.0), expected)).withColumn("weight", F.greatest(F.lit(1.0), expected)).withColumn("keep", draw() < F.col("probability")).drop("expected")


def copies() -> Column:
    """How often a drawn document of `sample` is to be written: `weight`, rounded up or down by its draw so that it is met on average."""
    whole = F.floor("weight")
    return (whole + (draw() < F.col("weight") - whole).cast("long")).cast("int")


def described(docs: DataFrame) -> DataFrame:
    """documents with n_tokens and topic."""
    return docs.withColumn("n_tokens", token_count(F.col("text"))).withColumn("topic", topic_of(F.col("text"), F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = materialize(described(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens"))
    return sample(slim, cell_weights(slim)).select("doc_id", "source", "lang", "topic", "n_tokens", "token_weight", "probability", "weight", "keep")
