"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Targets are the sources' weighted shares of the mix, limited by what a source can give. The mix is a sequence of equal-token
blocks, cut into shards; block after block goes to the source with the highest quotient target / (2 seats + 1), so that
every shard has integer quotas and all shards before it together keep the targets. A source's words, in seeded document
order, form its blocks; its quota is met by whole passes and an evenly spread, seeded choice of single blocks. Everything
after the word counts is closed arithmetic on running sums, so no block is ever a row unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelattice.llm.common import WORD_SQL, stored, whole_text

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SHARDS, SEED = 8, "mix"
BUCKET_ROWS = 50_000


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, k1, k2: words of every row, and the keys of the seeded order."""
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(
        "doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD_SQL)).cast("long").alias("size"),
        F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), text_id))).alias("k1"), F.unhex(F.md5(whole_text())).alias("k2"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, idx (order by code point, null last), weight, source_size, target for `rows` (source, size).

    A source is held at `most` times its size once the common rate of those not yet held, by ascending limit per weight, reaches
    that limit; one running sum over the sources finds where that ends. One row per source.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    goal = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    held = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("rate", (goal - held) / open_weight).withColumn("goal", goal)
    ok = F.when(F.col("rate") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "idx", "rate"))
    rate = F.min(ok).over(Window.partitionBy())["rate"]
    return per.withColumn("target", F.least("cap", rate * F.col("weight"))).select("source", "idx", "weight", "source_size", "goal", "target")


def seats(plan: DataFrame, house: Column, by: list[str]) -> DataFrame:
    """Sainte-Lague seats of the sources of `plan` (idx, target, goal) for a house per group `by`.

    Rounded shares miss the house by at most half the number of sources; the missing (or surplus) seats go by highest (lowest)
    quotients among the next ones of each source. Equal quotients favour the smaller idx.
    """
    every = Window.partitionBy(*by)
    first = plan.withColumn("house", house)
    first = first.withColumn("start", F.when(F.col("goal") > 0, F.floor(F.col("target") * F.col("house") / F.col("goal") + 0.5)).otherwise(0).cast("long"))
    first = first.withColumn("short", F.when(F.col("goal") > 0, F.col("house") - F.sum("start").over(every)).otherwise(0))
    more = first.withColumn("step", F.explode(F.sequence(F.lit(0), F.abs("short"))))
    # seat number whose quotient is compared: the next ones to give, or the last ones to take
    k = F.when(F.col("short") > 0, F.col("start") + F.col("step") - 1).otherwise(F.col("start") - F.col("step"))
    more = more.withColumn("quotient", F.when((F.col("step") > 0) & (k >= 0), F.col("target") / (2 * k + 1)))
    up = F.row_number().over(every.orderBy(F.col("quotient").desc_nulls_last(), "idx"))
    down = F.row_number().over(every.orderBy(F.col("quotient").asc_nulls_last(), F.desc("idx")))
    change = F.when(F.col("quotient").isNull(), 0).when((F.col("short") > 0) & (up <= F.col("short")), 1).when((F.col("short") < 0) & (down <= -F.col("short")), -1).otherwise(0)
    return more.withColumn("change", change).groupBy(*by, "idx").agg((F.first("start") + F.sum("change")).alias("seats"))


def quotas(plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """shard, idx, block, blocks: whole blocks every shard takes of every source. Block sizes: 1/64 of the smallest source that
    has words, from 1 to 256 words."""
    block = F.greatest(F.lit(1), F.least(F.lit(256), F.floor(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(Window.partitionBy()) / 64))).cast("long")
    plan = plan.withColumn("block", F.coalesce(block, F.lit(1)))
    ends = plan.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    total = F.round(F.col("goal") / F.col("block")).cast("long")
    upto = seats(ends, F.floor(total * F.col("shard") / shards).cast("long"), ["shard"])
    before = F.coalesce(F.lag("seats").over(Window.partitionBy("idx").orderBy("shard")), F.lit(0))
    return upto.withColumn("blocks", F.col("seats") - before).join(plan.select("idx", "block"), "idx").select("shard", "idx", "block", "blocks")


def chosen_before(x: Column, pick: Column) -> Column:
    """Words among the first x of a source that the single-block choice takes in its first `pick` picks (columns block, rest,
    full, phase)."""
    def before(j: Column) -> Column:
        wide = j.cast("decimal(19,0)") * F.col("rest").cast("decimal(19,0)") + F.col("phase")
        count = F.when(F.col("full") > 0, F.floor(wide / F.col("full").cast("decimal(19,0)")).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.least(count, pick)

    j = F.floor(x / F.col("block")).cast("long")
    return before(j) * F.col("block") + (x - j * F.col("block")) * (before(j + 1) - before(j))


def taken_before(lo: Column, hi: Column, pick: Column, most: int) -> Column:
    """Words from place lo to hi of a source that its first `pick` picks take: pass after pass over all blocks, then single blocks."""
    words = chosen_before(hi, F.greatest(pick - F.col("passes") * F.col("full"), F.lit(0)))
    words = words - chosen_before(lo, F.greatest(pick - F.col("passes") * F.col("full"), F.lit(0)))
    for p in range(most):
        blocks = F.least(F.greatest(pick - p * F.col("full"), F.lit(0)), F.when(F.col("passes") > p, F.col("full")).otherwise(0))
        end = blocks * F.col("block")
        words = words + F.greatest(F.least(hi, end) - F.least(lo, end), F.lit(0))
    return words


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard_taken, first_word of every row of `docs` (doc_id, text, source).

    taken counts the words the mix takes of the document, repeats included, at most `most` times its size (`most` is 2 at most);
    shard_taken lists them by shard: each shard takes as many blocks of a source as its quota says, in the seeded order; first_word is the document's place in its source's seeded order. A null text has size 0; null is a source of its own,
    last in order. Equal rows are interchangeable. Words after a source's last whole block are left out. Columns of other
    names are left aside; an empty table gives an empty result.
    """
    rows = stored(sized(docs, seed))
    plan = stored(targets(rows, weights, share, most))
    # the picks of a source that belong to each shard follow those of the shards before it
    ends = F.array_sort(F.collect_list(F.struct("shard", "upto")))["upto"]
    upto = F.sum("blocks").over(Window.partitionBy("idx").orderBy("shard"))
    given = quotas(plan, shards).withColumn("upto", upto).groupBy("idx").agg(F.sum("blocks").alias("quota"), ends.alias("ends"), F.first("block").alias("block"))
    full = F.floor(F.col("source_size") / F.col("block")).cast("long")
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null")))), 1, 8), 16, 10).cast("long")
    per = plan.join(given, "idx").withColumn("full", full).withColumn("quota", F.least(F.col("quota"), F.col("full") * most))
    per = per.withColumn("passes", F.when(F.col("full") > 0, F.floor(F.col("quota") / F.col("full"))).otherwise(0).cast("long"))
    per = per.withColumn("rest", F.col("quota") - F.col("passes") * F.col("full"))
    per = stored(per.withColumn("phase", F.when(F.col("full") > 0, phase % F.col("full")).otherwise(0)).select(
        F.col("source").alias("of"), "idx", "source_size", "target", "block", "full", "passes", "rest", "phase",
        F.transform("ends", lambda e: F.least(e, F.col("quota"))).alias("ends")))
    n = rows.count()
    digits = 1
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    placed = rows.join(per, rows.source.eqNullSafe(per.of)).withColumn("bucket", F.substring(F.hex("k1"), 1, digits))
    sums = placed.groupBy("idx", "bucket").agg(F.sum("size").alias("words"))
    lead = F.coalesce(F.sum("words").over(Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leads = sums.select("idx", "bucket", lead.alias("lead"))
    inside = Window.partitionBy("idx", "bucket").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(leads, ["idx", "bucket"]).withColumn("first_word", F.col("lead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    end = F.col("full") * F.col("block")
    lo, hi = F.least("first_word", end), F.least(F.col("first_word") + F.col("size"), end)
    placed = placed.withColumns({"lo": lo, "hi": hi})
    upto = F.transform("ends", lambda e: taken_before(F.col("lo"), F.col("hi"), e, most))
    placed = placed.withColumn("upto", upto)
    by_shard = F.transform("upto", lambda v, i: (v - F.when(i > 0, F.get(F.col("upto"), i - 1)).otherwise(0)).cast("long"))
    taken = F.coalesce(F.element_at("upto", -1), F.lit(0)).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), by_shard.alias("shard_taken"), "first_word")
