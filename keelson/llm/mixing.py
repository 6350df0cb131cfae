"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Time is counted in slots, each holds one block of ``block_rows`` rows. The
weights of the groups present, as the decimal fractions they are written as,
become whole shares without a common factor; the period is their sum. Block k
of a source with share a may not start before slot ``floor(k * period / a)``
(its release) and must be in a slot before ``ceil((k + 1) * period / a)`` (its
deadline). Each slot goes to the released block with the earliest deadline
(ties: the source that comes first by name). After any number of slots t a
source has had ``t * a / period`` blocks, its exact target, give or take less
than one.

As the windows repeat from one period to the next, so does the schedule: it is
made once, for one period, whatever the number of rows; block k of a source is
in slot ``(k div a) * period + slot_in_period[k mod a]``. If the weights have no
small common period, so that the rows end before it does, the schedule is made
for as many slots as the rows can need. All rows are then placed by arithmetic,
each on its own. The schedule is made slot by slot in one task: its cost is
linear in the smaller of both numbers (193 slots for the production weights).

No row is dropped: the schedule ends when each source has been read once from
its first to its last block. Sources that are scarce for their weight start
again from their first block (column ``epoch``). A row that is read often is
unfolded in ranges of ``UNFOLD`` epochs, which go to tasks of their own.

Defined results: sources that no weight names, null among them, form one group
``other``; groups without rows leave their weight to the rest; repeated rows
are placed each by itself; an empty table gives an empty result; columns named
like the added ones are replaced.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.shared import aside, back, number_rows, row_key, small, stored

#: Production targets: the largest source is held back, the others share the rest.
WEIGHTS = {"src0": 0.30} | {f"src{i}": 0.035 for i in range(1, 20)}
OTHER_WEIGHT = 0.035
BLOCK_ROWS = 16
#: So many slots of the schedule are made in one array; arrays of so many are then put together.
CHUNK_SLOTS = 1000
#: With a period up to this, blocks times period are taken as bigint, beyond it as decimal.
BIGINT_PERIOD = 1_000_000
#: So many epochs of a row are unfolded in one place.
UNFOLD = 64
ADDED = ("mix_group", "epoch", "block", "slot", "release", "deadline", "position")


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of the period by largest remainder, 1 at least."""
    if len(weights) > period:
        raise ValueError("the period must have a slot for each source")
    total = sum(weights.values())
    exact = {k: w * period / total for k, w in weights.items()}
    shares = {k: max(1, int(x)) for k, x in exact.items()}
    by_need = sorted(exact, key=lambda k: (shares[k] - exact[k], k))
    while (left := period - sum(shares.values())) > 0:
        for k in by_need[:left]:
            shares[k] += 1
    while sum(shares.values()) > period:
        shares[max(shares, key=lambda k: (shares[k] - exact[k], shares[k], k))] -= 1
    return shares


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers without a common factor."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    scale = math.lcm(*[x.denominator for x in exact.values()])
    whole = {k: int(x * scale) for k, x in exact.items()}
    common = math.gcd(*whole.values())
    return {k: x // common for k, x in whole.items()}


def exact_kind(period: int) -> str:
    """The SQL type in which a block's number times the period is exact."""
    return "bigint" if period <= BIGINT_PERIOD else "decimal(38,0)"


def period_schedule(spark, shares: dict[str, int], slots: int | None = None) -> DataFrame:
    """A row per source: grp, a (its share) and slots (array: the slot of each of
    its blocks within the period, or within its first ``slots`` slots), by
    earliest deadline first. A source without a slot there has no row."""
    names, period = sorted(shares), sum(shares.values())
    slots, kind = min(period, slots or period), exact_kind(period)
    number = lambda x: f"cast('{x}' AS {kind})"
    a, p = "array(" + ",".join(number(shares[k]) for k in names) + ")", number(period)
    x = f"cast(x AS {kind})"
    released = (f"filter(transform(s.c, (x, i) -> if({x} * {p} div {a}[i] <= t,"
                f" struct((({x} + 1) * {p} + {a}[i] - 1) div {a}[i] AS due, i AS i), NULL)), e -> e IS NOT NULL)")
    step = (f"transform(array(array_min({released}).i), p -> named_struct("
            "'c', transform(s.c, (x, i) -> x + if(i = p, 1L, 0L)), 'o', concat(s.o, array(p))))[0]")
    none = "cast(array() AS array<int>)"
    chunk = (f"aggregate(sequence(u * {CHUNK_SLOTS}L, least((u + 1) * {CHUNK_SLOTS}L, {slots}L) - 1),"
             f" named_struct('c', r.c, 'o', {none}), (s, t) -> {step})")
    order = (f"aggregate(sequence(0L, {(slots - 1) // CHUNK_SLOTS}L), named_struct('c', array_repeat(0L, {len(names)}),"
             f" 'o', cast(array() AS array<array<int>>)), (r, u) -> transform(array({chunk}), z -> named_struct("
             "'c', z.c, 'o', concat(r.o, array(z.o))))[0], r -> flatten(r.o))")
    one = spark.range(1).select(F.expr(order).alias("o"))
    picks = one.select(F.posexplode("o").alias("slot", "i"))
    grp = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    share = F.expr(f"{a}[any_value(i)]").alias("a")
    return picks.groupBy(grp.alias("grp")).agg(share, F.sort_array(F.collect_list("slot")).alias("slots"))


def mix(df: DataFrame, weights: dict[str, float] | None = None, other_weight: float = OTHER_WEIGHT,
        block_rows: int = BLOCK_ROWS, period: int | None = None, source: str = "source") -> DataFrame:
    """The rows of ``df`` in the order of the mixture: its columns, and

    - mix_group: the source, or ``other``
    - epoch: 0 for the first reading of the source
    - block: the block's number over all epochs; slot: where it stands
    - release, deadline: the slots that block may stand in (deadline exclusive)
    - position: unique, ascending in the order of the mixture

    With a ``period``, the targets are the weights rounded to whole shares of it.
    """
    spark = df.sparkSession
    df = df.drop(*ADDED)
    weights = dict(WEIGHTS if weights is None else weights)
    if "other" in weights or min([other_weight, *weights.values()]) <= 0:
        raise ValueError("weights are above 0; other is the group of the sources without one")
    named = F.col(source).isin(*weights) if weights else F.lit(False)
    grouped = df.withColumn("mix_group", F.when(named, F.col(source)).otherwise(F.lit("other")))
    # one row per weight at most
    rows = {r["mix_group"]: r["n"] for r in grouped.groupBy("mix_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    present = {k: w for k, w in (weights | {"other": other_weight}).items() if rows.get(k)}
    added = "struct<epoch:bigint,block:bigint,slot:bigint,release:bigint,deadline:bigint,position:bigint>"
    if not present:
        return grouped.withColumn("_s", F.lit(None).cast(added)).select(*grouped.columns, "_s.*").where(F.lit(False))
    shares = whole_shares(present, period) if period else exact_shares(present)
    period, blocks = sum(shares.values()), {k: -(-rows[k] // block_rows) for k in present}
    # by then each source has been read once
    slots = min(period, max(-(-n * period // shares[k]) for k, n in blocks.items()))
    sizes = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, {blocks[k]}L)" for i, k in enumerate(sorted(present))) + " AS t(i, blocks)")
    sizes = sizes.select(F.element_at(F.array(*map(F.lit, sorted(present))), F.col("i") + 1).alias("grp"), "blocks")
    plan = stored(period_schedule(spark, shares, slots), "schedule").join(sizes, "grp").withColumn("m", F.size("slots").cast("long"))
    last = F.expr(f"((blocks - 1) div m) * {slots} + slots[cast((blocks - 1) % m AS int)]")
    stop = plan.agg((F.max(last) + 1).alias("stop")).first()["stop"]
    plan = plan.withColumn("k_end", F.expr(f"{stop // slots}L * m + size(filter(slots, x -> x < {stop % slots}))"))
    numbered = number_rows(grouped, ["mix_group"], "__kl_i", order=df.columns)
    plan = plan.select(*[F.col(c).alias(f"__kl_{c}") for c in ("grp", "a", "m", "slots", "blocks", "k_end")])
    step = f"{UNFOLD}L * __kl_blocks"
    placed = (numbered.join(F.broadcast(plan), F.col("mix_group") == F.col("__kl_grp"))  # one row per weight at most
              .withColumn("__kl_q", F.expr(f"__kl_i div {block_rows}"))
              .withColumn("__kl_part", F.explode(F.expr(f"sequence(0L, (__kl_k_end - 1 - __kl_q) div ({step}))"))))
    if stop > UNFOLD * min(-(-n * period // shares[k]) for k, n in blocks.items()):  # some source is read that often
        placed = placed.repartition("mix_group", "__kl_i", "__kl_part")
    placed = (placed.withColumn("block", F.explode(F.expr(
        f"sequence(__kl_q + __kl_part * {step}, least(__kl_k_end - 1, __kl_q + (__kl_part + 1) * {step} - 1), __kl_blocks)")))
              .withColumn("slot", F.expr(f"(block div __kl_m) * {slots} + __kl_slots[cast(block % __kl_m AS int)]").cast("long")))
    kind = exact_kind(period)
    k, p = f"cast(block AS {kind})", f"cast('{period}' AS {kind})"
    return placed.select(
        *grouped.columns, F.expr("block div __kl_blocks").alias("epoch"), "block", "slot",
        F.expr(f"{k} * {p} div __kl_a").alias("release"),
        F.expr(f"(({k} + 1) * {p} + __kl_a - 1) div __kl_a").alias("deadline"),
        F.expr(f"slot * {block_rows} + __kl_i % {block_rows}").alias("position"))


def mix_documents(df: DataFrame, **how) -> DataFrame:
    """The rows of the mixture with the columns of ``df`` alone.

    Rows are placed by their keys; texts move only if there are too many keys to
    broadcast, and then once. Equal rows share a key: one of them stands for all,
    as often as the mixture has them."""
    rows = row_key(aside(df))
    keys = rows.select(F.col("`__in_source`").alias("source"), "__kl_key")
    placed = mix(keys, **how)
    times = placed.groupBy("__kl_key").agg(F.count(F.lit(1)).alias("__kl_times"), F.sum(F.when(F.col("epoch") == 0, 1)).alias("__kl_alike"))
    found = rows.join(small(stored(times, "mixture")), "__kl_key")
    one = found.where("__kl_alike = 1").unionByName(found.where("__kl_alike > 1").dropDuplicates(["__kl_key"]))
    return back(one.withColumn("__kl_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__kl_times"))))
