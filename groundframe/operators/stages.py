"""Construction stages: activation folded over ordered actions, and results by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def activation(actions: DataFrame, *, start: bool = False) -> DataFrame:
    """Rows of `actions` (region, seq, active boolean or null) with `is_active`: the last stated value up to the row, in
    order of seq, else `start` (WIN-01, WIN-03 with start true, WIN-04)."""
    w = Window.partitionBy("region").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return actions.withColumn("is_active", F.coalesce(F.last("active", ignorenulls=True).over(w), F.lit(start)))


def changes(folded: DataFrame, *, start: bool = False) -> DataFrame:
    """Rows of `activation` where the state turns, with `change` activated or deactivated (SET-09)."""
    w = Window.partitionBy("region").orderBy("seq")
    before = F.coalesce(F.lag("is_active").over(w), F.lit(start))
    turn = F.when(F.col("is_active") & ~before, "activated").when(~F.col("is_active") & before, "deactivated")
    return folded.withColumn("change", turn).where("change is not null")


def active_in(stages: Column, stage: Column) -> Column:
    """An empty or null list of stages means all of them (FLT-04 to FLT-06, FLT-15)."""
    return stages.isNull() | (F.size(stages) == 0) | F.array_contains(stages, stage)


def block_active(block: Column, inactive: Column, active: Column) -> Column:
    """Inactive wins; else membership of the explicit set; without one, true (FLT-11, WIN-06)."""
    listed = active.isNotNull() & (F.size(active) > 0)
    return ~F.coalesce(F.array_contains(inactive, block), F.lit(False)) & (~listed | F.array_contains(active, block))


def field_statistics(fields: DataFrame) -> DataFrame:
    """Per (stage, field): count, least, greatest and mean of the finite values (AGG-11)."""
    v = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return fields.groupBy("stage", "field").agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))


def metric_curves(metrics: DataFrame) -> DataFrame:
    """Per metric: points (seq, value) in order of stages, missing values left out (WIN-07, WIN-08)."""
    points = metrics.where("value is not null").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("p"))
    return points.select("name", F.transform("p", lambda x: x["seq"]).alias("x"), F.transform("p", lambda x: x["value"]).alias("y"))


def latest_results(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the latest by `order` (MUT-11, MUT-12)."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return results.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")


#: What a stage may state about a region, in the order in which it takes effect: the later wins.
STATEMENTS = ("map", "activate", "deactivate", "action_activate", "action_deactivate")


def stage_states(regions: DataFrame, stages: DataFrame, statements: DataFrame) -> DataFrame:
    """(stage, seq, region, is_active) of every region in every stage, from all active on (WIN-02, WIN-05).

    `regions`: (region); `stages`: (stage, seq); `statements`: (stage, region, kind of STATEMENTS, active). Within a stage the
    last kind wins; a stage carries its state on. A stage that leaves no region active has all of them, and what was stated up to it
    no longer counts. So a stage is emptied if every region's last statement is a no, and all of them are later than the last
    emptied stage: one pass over each region's stages gives a stage's earliest such statement, one over the stages themselves (a number each,
    in one row) tells which are emptied.
    """
    rank = F.array_position(F.array(*map(F.lit, STATEMENTS)), F.col("kind"))
    said = statements.groupBy("stage", "region").agg(F.max_by("active", rank).alias("said"))
    grid = regions.select("region").distinct().crossJoin(stages.select("stage", "seq").distinct()).join(said, ["stage", "region"], "left")  # one row a stage and region: the result
    w = Window.partitionBy("region").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("said").isNotNull(), F.struct("seq", "said")), ignorenulls=True).over(w)
    grid = grid.withColumn("last", last)
    off = F.when(~F.col("last.said"), F.col("last.seq"))
    per = grid.groupBy("seq").agg(F.min(off).alias("since"), (F.count(off) == F.count("*")).alias("off")).where("off")
    empty = F.aggregate(
        F.array_sort(F.collect_list(F.struct("seq", "since"))), F.array().cast("array<bigint>"),
        lambda done, x: F.when((F.size(done) == 0) | (x["since"] > F.try_element_at(done, F.lit(-1))), F.concat(done, F.array(x["seq"].cast("long")))).otherwise(done),
    )
    era = stages.select("seq").distinct().crossJoin(per.agg(empty.alias("empty"))).select("seq", F.array_max(F.filter("empty", lambda e: e <= F.col("seq"))).alias("era"))
    out = grid.join(era, "seq")
    counts = F.col("last").isNotNull() & (F.col("era").isNull() | (F.col("last.seq") > F.col("era")))
    return out.select("stage", "seq", "region", F.when(counts, F.col("last.said")).otherwise(True).alias("is_active"))


def shared_stages(a: Column, b: Column) -> Column:
    """Stages of both lists; an empty or null one means all (SET-13)."""
    none = lambda c: c.isNull() | (F.size(c) == 0)
    return F.when(none(a), b).when(none(b), a).otherwise(F.array_intersect(a, b))


def snapshot(blocks: Column, active: Column, inactive: Column) -> Column:
    """A phase's blocks: the explicit ones, or all, without the inactive ones, in order (MUT-15)."""
    base = F.when(active.isNull() | (F.size(active) == 0), blocks).otherwise(active)
    return F.array_sort(F.array_distinct(F.array_except(base, F.coalesce(inactive, F.array().cast("array<string>")))))


def results_for(results: DataFrame, stage: Column) -> DataFrame:
    """Results of a stage; a null stage has the results without one (FLT-07)."""
    return results.where(F.col("stage").eqNullSafe(stage))


def without_results(names: Column, tokens: tuple[str, ...] = ("stress", "strain", "disp", "result", "pore")) -> Column:
    """Whether a column isn't a result: its name holds none of the tokens as a word or a part between marks (MUT-13)."""
    return ~F.exists(F.split(F.lower(names), "[^a-z]+", -1), lambda t: t.isin(*tokens))
