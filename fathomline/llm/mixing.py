"""Temperature mixing of sources to target weights, in DataFrame operations only.

A source's weight is its token share to the power of an exponent, normalised. The exponent is found by
bisection, SECTIONS sections a pass, each pass one aggregate over the table of sources: the largest one
whose weights have the target entropy, raised if need be until no source is repeated more often than the
limit. Weights become a token budget for each source, and the budget becomes whole epochs of the source's
blocks and a part of one more: the blocks in a keyed permutation of that epoch until the budget is met, the
last block cut inside by the keyed order of its rows. A block is a hash range of a source's rows, so a source
of any size is spread over blocks; there are at most MAX_BLOCKS blocks more than sources.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm._common import dropped, saved, unused
from fathomline.llm.quality_rules import words_of

SECTIONS, PASSES = 16, 8
MAX_BLOCKS = 20_000
#: Words of a block, or more where the corpus has more than MAX_BLOCKS such blocks.
BLOCK_TOKENS = 100_000


@dataclass(frozen=True)
class Target:
    """entropy: the weights' entropy as a share of the greatest possible, ln(number of sources). repeats: most epochs of a source. budget: tokens in all; None: as many as there are; cover: as few as give every source a whole epoch."""

    entropy: float | None = 0.95
    repeats: float | None = 4.0
    budget: int | None = None
    cover: bool = False


def measures(shares: list[float], a: float, ratio: float | None) -> tuple[float, float]:
    """(entropy, epochs of the most repeated source) of weights of exponent a, in plain Python; ratio: budget to tokens, None: cover."""
    w = [s**a for s in shares]
    z = sum(w)
    scale = max(s / (x / z) for s, x in zip(shares, w)) if ratio is None else ratio
    return -sum(x / z * math.log(x / z) for x in w), max(x / z / s for s, x in zip(shares, w)) * scale


def _bisected(sources: DataFrame, exponents_ok, low: float, high: float, rising: bool) -> float:
    """The exponent in [low, high] where a monotone condition changes: the largest at which it holds, or, if rising, the smallest."""
    for _ in range(PASSES):
        points = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        row = sources.agg(*(exponents_ok(F.lit(p)).alias(f"c{k}") for k, p in enumerate(points))).first()
        good = [k for k in range(SECTIONS + 1) if row[f"c{k}"]]
        if not good:
            return high if rising else low
        k = min(good) if rising else max(good)
        if (k == 0 and rising) or (k == SECTIONS and not rising):
            return points[k]
        low, high = (points[k - 1], points[k]) if rising else (points[k], points[k + 1])
    return high if rising else low


def exponent(sources: DataFrame, target: Target) -> float:
    """The exponent, 0 (all sources alike) to 1 (as they come), for a table of sources with share, above 0 and summing to 1, and ratio, the budget as a multiple of all tokens."""
    share = F.col("share")

    def z(a: Column) -> Column:
        return F.sum(F.pow(share, a))

    def entropic(a: Column) -> Column:
        entropy = F.ln(z(a)) - a * F.sum(F.pow(share, a) * F.ln(share)) / z(a)
        return entropy >= target.entropy * F.ln(F.count("*")) - 1e-12

    def limited(a: Column) -> Column:
        scale = F.max(F.pow(share, 1 - a)) * z(a) if target.cover else F.first("ratio")
        return F.max(F.pow(share, a - 1)) / z(a) * scale <= target.repeats + 1e-12

    a = 1.0 if target.entropy is None else _bisected(sources, entropic, 0.0, 1.0, rising=False)
    return a if target.repeats is None else _bisected(sources, limited, a, 1.0, rising=True)


def _key(column: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def mixed(docs: DataFrame, target: Target = Target(), seed: int = 7, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs (any columns) once for each epoch that its budget gives a row, with epoch, block (int), block_order and row_order (long) appended; own columns of these names are replaced.

    Sorting by epoch, source, block_order and row_order gives the training order. A null source is a source of
    its own; null texts have no tokens. A source without tokens has no weight and its rows come once. Rows
    with one id and text stand together: all or none of them are in a part of an epoch. An empty table gives
    an empty result.
    """
    docs = docs.drop("epoch", "block", "block_order", "row_order")
    key, order = _key(source_col), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    rows = saved(docs.select(key.alias("key"), order.alias("h"), F.size(words_of(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("tokens")), "mixing-rows")
    sources = saved(rows.groupBy("key").agg(F.sum("tokens").alias("tokens")), "mixing-sources")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = total if target.budget is None else target.budget
    shares = sources.where("tokens > 0").select("key", "tokens", (F.col("tokens") / max(total, 1)).alias("share"), F.lit(budget / max(total, 1)).alias("ratio"))
    a = F.lit(exponent(shares, target) if total else 1.0)
    powers = shares.agg(F.sum(F.pow("share", a)), F.max(F.pow("share", 1 - a))).first()
    z, least = powers[0] or 1.0, powers[1] or 1.0
    if target.cover:
        budget = least * z * total
    size = max(block_tokens, -(-total // MAX_BLOCKS), 1)
    told = sources.join(shares.select("key", (F.pow("share", a) / z * budget).alias("goal")), "key", "left").select(
        "key", F.ceil(F.greatest(F.col("tokens"), F.lit(1)) / size).cast("int").alias("blocks"),
        # A goal that rounding leaves just under a whole epoch is that epoch.
        F.coalesce(F.floor(F.col("goal") / F.col("tokens") + 1e-9), F.lit(1)).cast("int").alias("whole"),
        F.coalesce(F.greatest(F.col("goal") - F.floor(F.col("goal") / F.col("tokens") + 1e-9) * F.col("tokens"), F.lit(0.0)), F.lit(0.0)).alias("rest"),
    )
    told = saved(told, "mixing-told")
    block = F.pmod("h", F.col("blocks")).cast("int")
    dealt = rows.join(told, "key").withColumn("block", block)
    place = F.xxhash64("key", "block", "whole", F.lit(seed + 1))
    upto = Window.partitionBy("key").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy("key", "block", "whole", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("place", place).withColumn("upto", F.sum("tokens").over(upto))
    before = F.col("upto") - F.col("tokens")
    state = F.when(F.col("rest") <= 0, 0).when(F.col("upto") <= F.col("rest"), 2).when(before < F.col("rest"), 1).otherwise(0)
    blocks = saved(sums.select("key", "block", "whole", state.alias("state"), (F.col("rest") - before).alias("left")), "mixing-blocks")
    # Inside the block that the budget ends in: the last row, in keyed order, that it still pays for.
    inner = F.xxhash64("h", F.lit(seed + 2))
    cut = dealt.select("key", "block", "h", "tokens").join(blocks.where("state = 1").select("key", "block", "left"), ["key", "block"]).groupBy("key", "left", inner.alias("o")).agg(F.sum("tokens").alias("tokens"))
    paid = F.sum("tokens").over(Window.partitionBy("key").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = cut.withColumn("paid", paid).where("paid <= left").groupBy("key").agg(F.max("o").alias("cut"))
    plan = saved(
        blocks.join(cut, "key", "left").select("key", "block", "whole", "state", "cut"),
        "mixing-plan",
    )
    dropped(rows, sources, blocks)
    # At most MAX_BLOCKS rows more than sources: the join is a broadcast while the number of sources allows it.
    row_key, row_hash, source, blocks, of, at, told_plan, copies = unused([*docs.columns, "epoch", "block"], "row_key", "row_hash", "source_key", "blocks", "plan_key", "plan_block", "plan", "copies")
    named = docs.withColumns({row_key: key, row_hash: order}).join(told.select(F.col("key").alias(source), F.col("blocks").alias(blocks)), F.col(row_key) == F.col(source))
    named = named.withColumn("block", F.pmod(row_hash, F.col(blocks)).cast("int"))
    plan = plan.select(F.col("key").alias(of), F.col("block").alias(at), F.struct("whole", "state", "cut").alias(told_plan))
    joined = named.join(plan, (F.col(row_key) == F.col(of)) & (F.col("block") == F.col(at)))
    inside, p = F.xxhash64(row_hash, F.lit(seed + 2)), F.col(told_plan)
    more = F.when((p["state"] == 2) | (p["state"] == 1) & (inside <= p["cut"]), 1).otherwise(0)
    out = joined.withColumn(copies, p["whole"] + more).where(F.col(copies) > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col(copies).cast("int") - 1)))
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns), "epoch", "block", F.xxhash64(row_key, "block", "epoch", F.lit(seed + 1)).alias("block_order"), inside.alias("row_order")
    )
