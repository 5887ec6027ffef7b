"""Graph operators over edges (source, target, relation), and loops of surface boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Rounds


def neighbours(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(node, other): one hop, undirected, distinct (GRA-03)."""
    e = edges if relations is None else edges.where(F.col("relation").isin(relations))
    both = e.select(F.col("source").alias("node"), F.col("target").alias("other")).union(e.select("target", "source"))
    return both.where("node <> other").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable (GRA-01); a node without another isn't listed, nulls are ignored.

    Rounds move every edge to smaller ends: a node's larger neighbours go to the least of its neighbourhood, then its
    smaller ones do. The number of edges stays linear, hubs too, since a node's least neighbour is a grouped minimum; each round is
    written to the shared folder, and the one before is deleted.
    """
    rounds = Rounds(edges.sparkSession)
    pairs = edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v"))
    now, before = rounds.write(pairs.distinct()), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = rounds.write(small.select("e.u", "e.v").where("u <> v").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        rounds.drop_before()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = state


def dangling(edges: DataFrame) -> DataFrame:
    """Nodes of an outline whose degree isn't two (GRA-06)."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).where("degree <> 2")


def boundary_edges(triangles: DataFrame) -> DataFrame:
    """(source, target): edges that one triangle (conn) uses, the smaller node first."""
    c = F.col("conn")
    pairs = F.array(*(F.struct(F.least(c[a], c[b]).alias("source"), F.greatest(c[a], c[b]).alias("target")) for a, b in ((0, 1), (1, 2), (2, 0))))
    return triangles.select(F.inline(pairs)).groupBy("source", "target").count().where("count = 1").select("source", "target")


def _dart(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def traced(edges: DataFrame) -> DataFrame:
    """Edges (source, target) in the order of their loops: (first, second, place, source, target, closed) (GRA-02).

    At a node, edges go on in pairs, in order of their other ends: the first with the second, the third with the fourth; so
    where loops meet every edge still lies in one of them. A walk that ends at a node with an odd number is open. A loop begins with its least edge
    (first, second), taken from the node that makes it least; an open walk at the lesser of its two ends. source and target are in the walk's
    direction. Repeated edges and those from a node to itself are left out.

    List ranking by pointer doubling: both directions of each edge know the one before; in each round they take over the pointer, the
    least edge met and its distance from the one they point to, so a loop of n edges takes about log n rounds, each a join on a key that is
    unique on both sides. What an edge has met and what the one it points to has met lie behind each other, so where their least edges are
    one, the whole loop has been met: the edge is done. All edges of its loop are by the next round, so it is looked up in that one only and
    then rests; short loops don't go through the rounds of long ones.
    """
    rounds = Rounds(edges.sparkSession)
    e = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    out = e.union(e.select("b", "a"))
    w = Window.partitionBy("a").orderBy("b")
    at = out.withColumn("turn", F.row_number().over(w))
    partner = F.when(F.col("turn") % 2 == 1, F.lead("b").over(w)).otherwise(F.lag("b").over(w))
    # what comes before a -> b is its partner at a, walked towards a
    at = at.withColumn("from", partner)
    me = _dart("a", "b")
    start = at.select(me.alias("me"), F.when(F.col("from").isNotNull(), F.struct(F.col("from").alias("a"), F.col("a").alias("b"))).alias("ptr"), me.alias("low"), F.lit(0).cast("long").alias("at"))
    start = start.withColumns({"tip": F.when(F.col("ptr").isNull(), F.col("me")), "hops": F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long"), "done": F.lit(False)})
    schema = start.schema

    def written(df: DataFrame) -> DataFrame:
        return edges.sparkSession.read.schema(schema).parquet(rounds.written(df.write.partitionBy("done").parquet))

    now, found = written(start), []
    while True:
        p = now.select(F.col("me").alias("ptr"), *(F.col(c).alias(f"p_{c}") for c in ("ptr", "low", "at", "tip", "hops", "done")))
        both = now.where("not done").join(p, "ptr", "left")
        has, less = F.col("ptr").isNotNull(), F.col("p_low") < F.col("low")
        step = both.select(
            "me", F.when(has, F.col("p_ptr")).alias("ptr"), F.when(has & less, F.col("p_low")).otherwise(F.col("low")).alias("low"), F.when(has & less, F.col("hops") + F.col("p_at")).otherwise(F.col("at")).alias("at"),
            F.coalesce("tip", F.when(has, F.col("p_tip"))).alias("tip"), F.when(has, F.col("hops") + F.col("p_hops")).otherwise(F.col("hops")).alias("hops"), (has & (F.col("p_done") | (F.col("p_low") == F.col("low")))).alias("done"),
        )
        now = written(step)
        found.append(now.where("done"))
        rounds.drop(f"{rounds.paths[-2]}/done=false")
        if now.where("not done and ptr is not null").isEmpty():
            break
    now = reduce(DataFrame.union, found, now.where("not done"))
    label = F.coalesce("tip", "low")
    all_ = now.select("me", label.alias("label"), F.when(F.col("tip").isNull(), F.col("at")).otherwise(F.col("hops")).alias("place"), F.col("tip").isNull().alias("closed"))
    best = all_.groupBy(F.least("me.a", "me.b").alias("x"), F.greatest("me.a", "me.b").alias("y")).agg(F.min(F.struct("label", "place", "me", "closed")).alias("r"))
    return best.select(F.col("r.label.a").alias("first"), F.col("r.label.b").alias("second"), "r.place", F.col("r.me.a").alias("source"), F.col("r.me.b").alias("target"), "r.closed")


def boundary_loops(triangles: DataFrame) -> DataFrame:
    """(first, second, edges, closed): the traced loops of a surface's boundary (GRA-02)."""
    t = traced(boundary_edges(triangles))
    return t.groupBy("first", "second", "closed").agg(F.count("*").alias("edges"))
