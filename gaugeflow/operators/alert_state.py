"""Alert state carried from block to block of time: replay without a whole series in one task, and the step of a running stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import compare_by

STATE = "rule string, generation long, labels_sig string, labels map<string,string>, tick long, since long, fired long"
DAY = 86_400_000
_KEY = ("rule", "labels_sig")
_BEFORE = -(2**62)


def advance(ticks: DataFrame, rules: DataFrame, carried: DataFrame | None = None, block_ms: int = DAY, keep_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(transitions, state behind the last tick) of ``ticks``, going on from the state ``carried``.

    ``ticks`` (rule or expr, labels, labels_sig, tick, value) hold one row a series and
    tick and, where a state is carried, later ticks only. ``rules`` have (rule, expr, op,
    threshold, hold_ms) and may have a generation: a state is carried to the rule of its
    name and generation, so a changed rule needs a new one, and the state of a dropped
    rule ends. The transitions are those of ``timeline``.

    A series is cut into blocks of time. Each block is summed up by its ends and its last
    turn, the summaries of a series (a row a block) pass on since when the threshold is
    crossed and whether the alert fired, and the rows of a block are judged with that. No
    task sorts more than a block. A state is kept only while the threshold is crossed and,
    with ``keep_ms``, while its last tick is no older than that. Empty frames give empty ones.
    """
    if "generation" not in rules.columns:
        rules = rules.withColumn("generation", F.lit(0).cast("long"))
    if "rule" in ticks.columns:
        ticks = ticks.drop("expr")
    rows = ticks.join(rules, "rule" if "rule" in ticks.columns else "expr")
    rows = rows.withColumns({"crossed": compare_by(F.col("value"), F.col("op"), F.col("threshold")), "block": F.floor(F.col("tick") / block_ms)})
    inside = Window.partitionBy(*_KEY, "block").orderBy("tick")
    rows = rows.withColumn("was_crossed", F.lag("crossed").over(inside))
    blocks = rows.groupBy(*_KEY, "block").agg(
        F.min("tick").alias("first_tick"), F.min_by("crossed", "tick").alias("first_crossed"), F.max("tick").alias("last_tick"), F.max_by("crossed", "tick").alias("last_crossed"),
        F.max(F.when(F.col("was_crossed") != F.col("crossed"), F.col("tick"))).alias("turned"), F.max("hold_ms").alias("hold_ms"), F.max("generation").alias("generation"), F.max_by("labels", "tick").alias("labels"), F.lit(None).cast("long").alias("fired"),
    )
    before = None
    if carried is not None:
        before = carried.join(rules.select("rule", "generation", "hold_ms"), ["rule", "generation"])
        yes = F.lit(True)
        held = before.select(*_KEY, F.lit(_BEFORE).alias("block"), F.col("tick").alias("first_tick"), yes.alias("first_crossed"), F.col("tick").alias("last_tick"), yes.alias("last_crossed"), F.col("since").alias("turned"), "hold_ms", "generation", "labels", "fired")
        blocks = blocks.unionByName(held)

    # What each block ends with, and what it begins with.
    series = Window.partitionBy(*_KEY).orderBy("block")
    past = F.lag("last_crossed").over(series)
    blocks = blocks.withColumn("turned", F.coalesce("turned", F.when(past.isNull() | (past != F.col("first_crossed")), F.col("first_tick"))))
    blocks = blocks.withColumn("since", F.last("turned", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = blocks.withColumn("held", F.when(F.col("block") == _BEFORE, F.col("fired").isNotNull()).otherwise(F.col("last_crossed") & (F.col("last_tick") - F.col("since") >= F.col("hold_ms"))))
    entered = blocks.select(*_KEY, "block", past.alias("in_crossed"), F.lag("since").over(series).alias("in_since"), F.lag("held").over(series).alias("in_held"))

    rows = rows.join(entered, [*_KEY, "block"])
    known = F.coalesce("was_crossed", "in_crossed")
    rows = rows.withColumn("turn", known.isNull() | (known != F.col("crossed")))
    rows = rows.withColumn("since", F.coalesce(F.max(F.when(F.col("turn"), F.col("tick"))).over(inside), "in_since"))
    rows = rows.withColumn("held", F.col("crossed") & (F.col("tick") - F.col("since") >= F.col("hold_ms")))
    rows = rows.withColumn("was_held", F.coalesce(F.lag("held").over(inside), "in_held", F.lit(False)))
    rows = rows.withColumns({"fires": F.col("held") & (F.col("turn") | ~F.col("was_held")), "ends": F.col("turn") & ~F.col("crossed") & F.col("was_held")})
    moves = rows.where(F.col("fires") | F.col("ends")).withColumn("earlier", F.lag(F.when(F.col("fires"), F.col("tick"))).over(inside))

    fires = moves.groupBy(*_KEY, "block").agg(F.max(F.when(F.col("fires"), F.col("tick"))).alias("fired"))
    if before is not None:
        fires = fires.unionByName(before.select(*_KEY, F.lit(_BEFORE).alias("block"), "fired"))
    earlier = F.last("fired", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    moves = moves.join(fires.select(*_KEY, "block", earlier.alias("in_fired")), [*_KEY, "block"])
    transitions = moves.select(
        "rule", "expr", "op", "threshold", "value", F.when(F.col("fires"), "firing").otherwise("resolved").alias("status"), "labels", "labels_sig",
        F.when(F.col("fires"), F.col("tick")).otherwise(F.coalesce("earlier", "in_fired")).alias("fired_at"), F.when(F.col("ends"), F.col("tick")).alias("resolved_at"),
    )

    last = blocks.groupBy(*_KEY).agg(F.max_by(F.struct("generation", "labels", "last_tick", "last_crossed", "since", "held"), "block").alias("x")).select(*_KEY, "x.*").where("last_crossed")
    fired = fires.groupBy(*_KEY).agg(F.max("fired").alias("fired"))
    state = last.join(fired, list(_KEY), "left").select("rule", "generation", "labels_sig", "labels", F.col("last_tick").alias("tick"), "since", F.when(F.col("held"), F.col("fired")).alias("fired"))
    if keep_ms is not None:
        newest = blocks.agg(F.max("last_tick").alias("t")).scalar()
        state = state.where(F.col("tick") >= newest - keep_ms)
    return transitions, state


def replay(ticks: DataFrame, rules: DataFrame, block_ms: int = DAY) -> DataFrame:
    """The transitions of ``timeline``, by blocks of time."""
    return advance(ticks, rules, block_ms=block_ms)[0]
