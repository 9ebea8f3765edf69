"""Mixing sources to target weights by temperature, natively in SQL.

A source's weight is its share of all tokens to the power of an exponent
between 0 (all alike) and 1 (as they are), normalised.  The exponent is the
least at which the weights' entropy has come down to ``entropy`` of its most
and no source is repeated more than ``max_repeat`` times; where both can't be
had, the repetition limit wins.  It is found by bisection, 64 parts a pass, each
pass one aggregation over the table of sources.

The weights are realised as budgeted block permutations.  A source's documents
are dealt by hash into blocks of about ``block_tokens``; an epoch takes all
blocks in an order of its own, and within a block documents keep one random
order.  A source gets whole epochs, then the part of one more that fits its
budget.  Offsets are running sums, within blocks and over the small table of
blocks, so the largest source is split over all tasks.

Without ``budget``, the budget is the least at which every source is taken at
least once: nothing is dropped, and smaller sources are repeated.

Tokens are runs of ``[^\\x20\\x09-\\x0D]``.  Defined results: a null text has no
token; a null source is a source; documents without tokens cost nothing, stand
at the beginning of their block and are taken in every whole epoch, and in the
last one if their block begins in it; repeated rows are each dealt; a null key is drawn by its
text, and rows of one key stand in the order of their texts' hashes (equal texts
are interchangeable); an empty table gives an empty result.  Columns in ``keep`` travel in one struct, so names do not clash.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.shared import Written

WORD = r"[^\x20\x09-\x0D]+"
PARTS, PASSES = 64, 4


class Mixture(NamedTuple):
    exponent: float
    total: int
    #: Sum of all shares to the power of the exponent.
    norm: float
    budget: float


def _measures(sources: DataFrame, total: int, grid: list[float], budget: float | None) -> list[tuple[float, float, float, float]]:
    """(exponent, normaliser, entropy, most repetitions) at each exponent of the grid."""
    share = F.col("tokens") / F.lit(float(total))
    rows = sources.where("tokens > 0").select("tokens", share.alias("p"), F.explode(F.array(*map(F.lit, grid))).alias("x"))
    power = F.pow("p", F.col("x"))
    sums = rows.groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"), F.max(F.col("tokens") / power).alias("most"), F.min(F.col("tokens") / power).alias("least"))
    out = []
    for r in sums.collect():  # one row for each exponent of the grid
        spent = r.most * r.z if budget is None else budget
        out.append((r.x, r.z, math.log(r.z) - r.x * r.s / r.z, spent / (r.z * r.least)))
    return sorted(out)


def find_exponent(sources: DataFrame, entropy: float = 0.95, max_repeat: float = 4.0, budget: float | None = None) -> Mixture | None:
    """The mixture of sources (columns tokens, ...); None without tokens."""
    total, n = sources.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return None
    target, lo, hi, last = entropy * math.log(n), 0.0, 1.0, None
    for k in range(PASSES):
        grid = [lo + (hi - lo) * j / PARTS for j in range(PARTS + 1)]
        found = _measures(sources, total, grid, budget)
        good = [j for j, (_, _, h, most) in enumerate(found) if round(h - target, 9) <= 0 and round(most - max_repeat, 9) <= 0]
        at = good[0] if good else PARTS
        last = found[at]
        if not at or (not good and not k):
            break
        lo, hi = found[at - 1][0], found[at][0]
    x, z, _, _ = last
    spent = budget
    if spent is None:
        spent = z * sources.where("tokens > 0").agg(F.max(F.col("tokens") / F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x)))).first()[0]
    return Mixture(x, total, z, spent)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None, entropy: float = 0.95, max_repeat: float = 4.0, budget: float | None = None, block_tokens: int = 1 << 18, seed: int = 7) -> DataFrame:
    """(row, tokens, exponent, weight, epoch, block, start_token), one row for each time a document is taken.

    row: the columns named in keep (all by default).  start_token: the offset
    in the source's stream of that epoch.
    """
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.col(text)))
    rows = docs.select(
        F.to_json(F.struct(F.col(source).cast("string").alias("s"))).alias("sid"),  # null is a source too
        draw.alias("draw"),
        F.xxhash64(F.col(text)).alias("tie"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        F.struct(*(keep or docs.columns)).alias("row"),
        F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("worded"),
    )
    narrow = Written(rows.select("sid", "draw", "tokens"), "tokens").df
    sources = Written(narrow.groupBy("sid").agg(F.sum("tokens").alias("tokens")), "sources").df
    found = find_exponent(sources, entropy, max_repeat, budget) or Mixture(1.0, 1, 1.0, 0.0)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(found.total)), F.lit(found.exponent)) / F.lit(found.norm)).otherwise(0.0)
    taken = F.floor(F.round(F.col("weight") * F.lit(float(found.budget)), 3)).cast("long")
    plan = (
        sources.withColumn("weight", weight)
        .withColumn("target", F.when(F.col("tokens") > 0, taken).otherwise(0))
        .withColumn("whole", F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(1))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("target") % F.col("tokens")).otherwise(0))
        .select("sid", "weight", "whole", "rest", F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).alias("n_blocks"))
    )
    plan = Written(plan, "plan").df
    block = F.pmod(F.shiftright("draw", 20), F.col("n_blocks")).alias("block")
    sizes = narrow.join(plan, "sid").select("sid", "whole", "rest", block, "tokens").groupBy("sid", "whole", "rest", "block").agg(F.sum("tokens").alias("size"))
    epochs = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)))).where((F.col("whole") > 0) | (F.col("rest") > 0))
    in_epoch = Window.partitionBy("sid", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "sid", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = epochs.select("sid", "block", "epoch", F.coalesce(F.sum("size").over(in_epoch), F.lit(0)).alias("base"))
    bases = Written(bases.groupBy("sid", "block").agg(F.collect_list(F.struct("epoch", "base")).alias("bases")), "bases").df  # one entry for each epoch
    in_block = Window.partitionBy("sid", "block").orderBy("draw", "tie").rowsBetween(Window.unboundedPreceding, -1)
    dealt = lambda some: some.join(plan, "sid").select("sid", "draw", "tie", "tokens", "row", "weight", "whole", "rest", block)
    placed = dealt(rows.where("worded")).withColumn("before", F.coalesce(F.sum("tokens").over(in_block), F.lit(0)))
    # any number of rows without tokens stands where their block begins, so no task orders them
    bare = dealt(rows.where("not worded")).withColumn("before", F.lit(0).cast("long"))
    # joined before their union: ordered texts lie by block already and are not shuffled a second time
    based = lambda some: some.join(bases, ["sid", "block"]).select("row", "tokens", "weight", "whole", "rest", "block", "before", F.explode("bases").alias("b"))
    copies = based(placed).union(based(bare))
    start = F.col("b.base") + F.col("before")
    return copies.where((F.col("b.epoch") < F.col("whole")) | (start + F.col("tokens") <= F.col("rest"))).select(
        "row", "tokens", F.lit(found.exponent).alias("exponent"), "weight", F.col("b.epoch").alias("epoch"), "block", start.alias("start_token")
    )
