"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent between 0 (all equal) and 1 (as they are) and normalised. The exponent is
bisected until the mix meets a target entropy, or is the flattest one that repeats no source more than
``max_repeats`` times. Weights become whole epochs and a part of one more: a source's documents are dealt into
blocks by a hash of the id; every epoch is a permutation of the blocks by a seeded hash, and of the last
epoch the first blocks are taken that fit the source's token budget. ``order_key`` in [0, 1) sorts all
sources' rows into one evenly mixed stream.

Plan: tokens per (source, block) are summed in the map tasks first; a source with a third of all rows is as many
groups as it has blocks. Bisection reads only that table, 32 exponents a job, and fetches one row of figures. The block
schedule (sources x blocks x epochs) joins back on (source, block).

Without a budget it is the least that shows every document at least once, so that nothing is lost; with
``budget_tokens`` sources may fall below one epoch. A last epoch falls short of its budget by less than a block.

Defined cases: a null source is the source ''; a null text has no words; a source without any word has weight 0
and its rows come once, in epoch 0; repeated rows count and come as often as they stand; a null id is hashed like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import materialize

BLOCKS, SEED, MAX_REPEATS = 256, 17, 2.0
_GRID = 32


def word_count(text) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column."""
    parts = F.split(F.col(text), "[\\x20\\x09-\\x0D]+")
    edge = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    n = F.when(F.size(parts) == 1, F.lit(1) - (F.element_at(parts, 1) == "").cast("int")).otherwise(F.size(parts) - edge)
    return F.coalesce(n, F.lit(0)).cast("long")


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """The rows with mix_source, mix_block and mix_tokens added."""
    return docs.withColumns({
        "mix_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "mix_block": F.pmod(F.xxhash64(F.col(key), F.lit("block")), F.lit(blocks)).cast("int"),
        "mix_tokens": word_count(text),
    })


def _figures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy in nats, most repeats) of each exponent; ``sources`` has tokens and share."""
    aggs = []
    for i, a in enumerate(exponents):
        aggs += [F.sum(F.pow("share", F.lit(a))).alias(f"z{i}"),
                 F.sum(F.pow("share", F.lit(a)) * F.log("share")).alias(f"s{i}"),
                 F.max(F.pow("share", F.lit(a - 1))).alias(f"hi{i}"), F.min(F.pow("share", F.lit(a - 1))).alias(f"lo{i}")]
    row = sources.agg(*aggs).first()
    return [(math.log(row[f"z{i}"]) - a * row[f"s{i}"] / row[f"z{i}"], row[f"hi{i}"] / row[f"lo{i}"])
            for i, a in enumerate(exponents)]


def fit_exponent(sources: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS) -> float:
    """Smallest exponent whose entropy is at most the target, or whose repeats (the largest source shown once) are at most
    ``max_repeats``. Both fall as the exponent grows. Each job narrows the interval 32-fold."""
    low, high = 0.0, 1.0
    met = (lambda f: f[0] <= target_entropy) if target_entropy is not None else (lambda f: f[1] <= max_repeats)
    if met(_figures(sources, [0.0])[0]):
        return 0.0
    for _ in range(6):
        grid = [low + (high - low) * k / _GRID for k in range(1, _GRID)]
        good = [a for a, f in zip(grid, _figures(sources, grid)) if met(f)]
        below = [a for a in grid if not good or a < good[0]]
        low, high = (below[-1] if below else low), (good[0] if good else high)
    return high


def schedule(rows: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS,
             budget_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """(mix_source, mix_block, weight, repeats, epoch, place) of every block to show; ``rows`` as from ``keyed``."""
    blocks = materialize(rows.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens")))
    sources = blocks.groupBy("mix_source").agg(F.sum("block_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_blocks"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    real = materialize(sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(max(total, 1))))
    if not total:
        return blocks.select("mix_source", "mix_block", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"),
                             F.lit(0).alias("epoch"), F.lit(0).alias("place"), F.lit(1).alias("n_blocks"))
    a = fit_exponent(real, target_entropy, max_repeats)
    z, most = real.agg(F.sum(F.pow("share", F.lit(a))), F.max(F.pow("share", F.lit(1 - a)))).first()
    budget = budget_tokens if budget_tokens is not None else total * z * most
    plan = real.withColumn("weight", F.pow("share", F.lit(a)) / F.lit(z))
    plan = plan.withColumn("repeats", F.round(F.col("weight") * F.lit(budget) / F.col("tokens"), 9))
    plan = plan.unionByName(sources.where("tokens = 0").selectExpr(
        "mix_source", "tokens", "n_blocks", "0D as share", "0D as weight", "1D as repeats"))
    shown = blocks.join(plan, "mix_source").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("repeats").cast("int") - 1))))
    order = Window.partitionBy("mix_source", "epoch").orderBy(
        F.xxhash64(F.lit(seed), "epoch", "mix_source", "mix_block"), "mix_block")
    shown = shown.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "upto", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("epoch") + 1 <= F.col("repeats")) | (
        F.col("upto") <= (F.col("repeats") - F.col("epoch")) * F.col("tokens"))
    return materialize(shown.where(fits).select("mix_source", "mix_block", "weight", "repeats", "epoch", "place", "n_blocks"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", blocks: int = BLOCKS,
        seed: int = SEED, **target) -> DataFrame:
    """The rows of ``docs`` as often as the mix shows them, with mix_tokens, weight, epoch, block and order_key."""
    clash = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in clash.items()])
    rows = keyed(plain, clash[text], clash[key], clash[source], blocks)
    # the schedule needs only counts: no texts pass its shuffle
    plan = schedule(rows.select("mix_source", "mix_block", "mix_tokens"), seed=seed, **target)
    out = rows.join(plan, ["mix_source", "mix_block"])
    spot = (F.pmod(F.xxhash64(F.lit(seed), clash[key], "epoch"), F.lit(1 << 20)) + 0.5) / F.lit(float(1 << 20))
    out = out.withColumn("order_key", (F.col("epoch") + (F.col("place") + spot) / F.col("n_blocks")) / F.greatest(
        F.ceil("repeats"), F.lit(1)))
    names = [F.col(n).alias(c) for c, n in clash.items()]
    added = [("mix_tokens", "mix_tokens"), ("weight", "mix_weight"), ("epoch", "mix_epoch"), ("mix_block", "mix_block"),
             ("order_key", "mix_order")]
    return out.select(*names, *[F.col(a).alias(b) for a, b in added if b not in docs.columns])


def op10(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"),
                      F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_order").alias("order_key"))


def stage(docs: DataFrame, max_repeats: float = 1.5) -> DataFrame:
    """The documents as often as the mix shows them (each at least once), same columns."""
    return mix(docs, max_repeats=max_repeats).select(*docs.columns)
