"""Sources mixed to target shares of all tokens, in proportionate-fair order.

Each source's documents, in a random but fixed order and repeated pass after pass up to its cap, form a stream that is cut
into blocks of equal size. Block k of a source with share w is released at floor(k / w) and due at ceil((k + 1) / w);
taking in every slot the released block that is due first keeps each source within one slot of its share at any point of
the mixture. A document goes with the slot that holds its middle, so half of the longest document comes on top of that.
Slots are therefore at least as long as the longest document, and the block that bounds the deviation is two slots. The
last documents of a source are those that fit, then the largest one that fits into what they leave, so that shares come
out exact but for a rest smaller than any document left over. The schedule has a bounded number of slots whatever the
size of the data, as the slot grows with it beyond MAX_SLOTS; the places of the documents come from sums over ranges of
their order, never from one long window.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.tokens import VOCABULARY, token_counts
from corvane.session import Scratch, bounded_rows

#: Documented bounds: sources of a mixture, slots of a schedule.
MAX_SOURCES = 100_000
MAX_SLOTS = 200_000


def schedule(weights: dict[str, float], slots: int, blocks: dict[str, int] | None = None) -> list[tuple[int, str, int]]:
    """(slot, source, block) by earliest deadline first among released blocks. With ``blocks``, a source that has its number
    of blocks is left out from then on; as many slots as there are blocks then hold every block once."""
    total = sum(weights.values())
    share = {s: Fraction(w / total).limit_denominator(10**9) for s, w in weights.items() if w > 0}
    waiting = [(0, s, 0) for s in sorted(share)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []  # deadline, release, source, block
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((k + 1) / share[s]), release, s, k))
        if not ready:  # rounding left the slot open: the next block starts early
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((k + 1) / share[s]), release, s, k))
        _, _, s, k = heapq.heappop(ready)
        out.append((t, s, k))
        if blocks is None or k + 1 < blocks[s]:
            heapq.heappush(waiting, (math.floor((k + 1) / share[s]), s, k + 1))
    return out


@dataclass
class Mixture:
    """``plan``: one row per use of a document, ``(slot, source, key, use, tokens, start)``, in order of slot and start;
    ``shares``: ``(source, target_share, reachable_share, tokens, documents, most_uses, actual_share, due, deviation)`` per
    source, deviation being the tokens above those that are due; ``block``: tokens within which every source stays of its
    share wherever the plan is cut between slots."""

    plan: DataFrame
    shares: DataFrame
    block: int


def mix(
    df: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total: int | None = None,
    least_block: int = 8192,
    rows_per_range: int = 50_000,
    seed: int = 11,
    vocabulary: str = VOCABULARY,
) -> Mixture:
    """A mixture of documents in which each source has its target share of all tokens.

    ``targets`` gives ``source, target_share, max_repeats``. Sources without documents can't have a share: theirs goes to
    the others in proportion. By default the mixture is as large as the shares allow, that is, until the scarcest source
    is used up at its cap. A larger ``total`` uses scarce sources up to their caps and reports what was reached. Null and
    empty texts, documents whose source is null or has no target, and sources with a null or non-positive share or cap are
    left out; repeated rows count as documents of their own; a null key is kept; other columns are not read; empty tables
    give an empty plan.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mixing")
    wanted = bounded_rows(targets.select("source", "target_share", "max_repeats"), MAX_SOURCES, "targets")
    share = {r[0]: float(r[1]) for r in wanted if r[0] is not None and (r[1] or 0) > 0 and (r[2] or 0) > 0}
    cap = {r[0]: int(r[2]) for r in wanted if r[0] in share}
    named = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    listed = F.broadcast(spark.createDataFrame([(s,) for s in share], "source string"))  # at most MAX_SOURCES rows
    sized = scratch.keep(token_counts(named.join(listed, "source", "left_semi"), keep=("key", "source"), vocabulary=vocabulary).where("tokens > 0"), "sizes")
    facts_of = sized.groupBy("source").agg(F.sum("tokens"), F.count("*"), F.max("tokens")).collect()  # one row per target
    supply = {r[0]: (r[1], r[2]) for r in facts_of}
    longest = max((r[3] for r in facts_of), default=0)
    have = {s: w for s, w in share.items() if s in supply}
    weight = {s: w / sum(have.values()) for s, w in have.items()}
    largest = min((supply[s][0] * cap[s] / w for s, w in weight.items()), default=0)
    goal = min(largest, total) if total else largest
    take = {s: int(w * goal) for s, w in weight.items()}
    if total and total > largest:
        take = _fill(weight, {s: supply[s][0] * cap[s] for s in weight}, total)
    actual = sum(take.values())
    width = max(-(-least_block // 2), longest, -(-actual // MAX_SLOTS), 1)  # of a slot; the block is two
    blocks = {s: -(-t // width) for s, t in take.items() if t}
    order = schedule({s: take[s] for s in blocks}, sum(blocks.values()), blocks) if actual else []
    place = spark.createDataFrame([(s, k, t) for t, s, k in order], "source string, block bigint, slot bigint")

    # ranges of each source's order, of about rows_per_range documents, and what stands before each range
    ranges = {s: max(1, -(-n // rows_per_range)) for s, (_, n) in supply.items()}
    facts = F.broadcast(spark.createDataFrame([(s, ranges[s], take[s], supply[s][0]) for s in weight], "source string, ranges bigint, take bigint, supply bigint"))
    mixed = F.xxhash64("key", "tokens", F.lit(seed))
    placed = sized.join(facts, "source").withColumn("mark", mixed)
    low = F.shiftrightunsigned("mark", 33)  # 31 bits
    placed = placed.withColumn("range", F.floor(low * F.col("ranges") / F.lit(2**31)))
    sums = placed.groupBy("source", "range").agg(F.sum("tokens").alias("own"))
    before = sums.withColumn("before", F.coalesce(F.sum("own").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("own")
    within = Window.partitionBy("source", "range").orderBy("mark", "key", "tokens")
    at = placed.join(before, ["source", "range"]).withColumn("at", F.col("before") + F.sum("tokens").over(within) - F.col("tokens"))
    at = scratch.keep(at.select("source", "key", "tokens", "at", "take", "supply", (F.col("take") % F.col("supply")).alias("rest")), "at")
    fits = F.col("at") + F.col("tokens") <= F.col("rest")  # in the last, partial pass
    reach = at.groupBy("source").agg(F.max(F.when(fits, F.col("at") + F.col("tokens")).otherwise(0)).alias("reach"))  # one row per target
    spare = at.join(F.broadcast(reach), "source").where(~fits & (F.col("tokens") <= F.col("rest") - F.col("reach")))
    extra = spare.groupBy("source").agg(F.max(F.struct("tokens", "at", "reach")).alias("x")).select("source", F.col("x.at").alias("at"), F.col("x.reach").alias("reach"))
    marked = at.join(F.broadcast(extra), ["source", "at"], "left")
    whole = F.floor(F.col("take") / F.col("supply")).cast("int")
    uses = whole + F.when(fits | F.col("reach").isNotNull(), 1).otherwise(0)
    used = marked.where(uses > 0).select("*", whole.alias("whole"), F.posexplode(F.sequence(F.lit(1), uses)).alias("use0", "use"))
    last = (F.col("use0") == F.col("whole")) & F.col("reach").isNotNull()
    used = used.select("source", "key", "use", "tokens", (F.when(last, F.col("reach")).otherwise(F.col("at")) + F.col("use0") * F.col("supply")).alias("start"))
    placed = used.withColumn("block", F.floor((F.col("start") + F.col("tokens") / 2) / width)).join(F.broadcast(place), ["source", "block"], "left")
    slot = F.when(F.col("slot").isNull(), F.raise_error(F.lit("a use has no slot"))).otherwise(F.col("slot"))  # no use may get lost
    plan = placed.select(slot.cast("bigint").alias("slot"), "source", F.col("key").alias(key), "use", "tokens", "start")
    plan = scratch.keep(plan, "plan")
    got = plan.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("use").alias("most_uses"))
    every = got.agg(F.sum("tokens").alias("every"))
    aims = F.broadcast(spark.createDataFrame([(s, share[s], weight.get(s, 0.0), take.get(s, 0)) for s in share], "source string, target_share double, reachable_share double, due bigint"))
    shares = aims.join(got, "source", "left").join(F.broadcast(every), F.lit(True), "left").select(
        "source", "target_share", "reachable_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)).alias("actual_share"),
        "due", (F.coalesce("tokens", F.lit(0)) - F.col("due")).alias("deviation"),
    )
    return Mixture(plan, shares, 2 * width)


def _fill(weight: dict[str, float], most: dict[str, int], total: int) -> dict[str, int]:
    """Tokens per source for a total beyond what the shares allow: scarce sources in full, the rest in proportion."""
    out: dict[str, int] = {}
    left, open_ = float(total), dict(weight)
    while open_:
        scale = left / sum(open_.values())
        scarce = [s for s, w in open_.items() if most[s] <= w * scale]
        if not scarce:
            return out | {s: int(w * scale) for s, w in open_.items()}
        for s in scarce:
            out[s] = most[s]
            left -= most[s]
            del open_[s]
    return out
