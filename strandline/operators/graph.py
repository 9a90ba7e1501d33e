"""Graphs as tables ``nodes(id)`` and ``edges(src, dst)``.

Iterations are joins and map-side-combined sums; state is a table by node, and
its lineage is cut in the shared folder every few rounds. Adjacency of a node is
never gathered, so a hub spreads over the partitions of its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import settle

#: Rounds between two cuts of the lineage.
CUT_EVERY = 4


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops and nulls."""
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, smaller end first."""
    return simple_edges(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    u = undirected(edges)
    return u.unionByName(u.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree``."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    d = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.join(d, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``n_nodes, n_edges, density, mean_out_degree``."""
    return nodes.agg(F.count("*").alias("n_nodes")).withColumn("one", F.lit(1)).join(
        edges.agg(F.count("*").alias("n_edges")).withColumn("one", F.lit(1)), "one").select(
        "n_nodes", "n_edges", F.round(F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), 8).alias("density"),
        F.round(F.try_divide(F.col("n_edges"), F.col("n_nodes")), 6).alias("mean_out_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``id, rank``: fixed rounds, dangling mass spread evenly, sum 1."""
    out = edges.groupBy("src").agg(F.count("*").alias("k"))
    links = settle(edges.join(out, "src"))
    all_nodes = settle(nodes.join(out.withColumnRenamed("src", "id"), "id", "left"))
    n = all_nodes.count()
    ranks = all_nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank"), F.col("k").isNull().alias("dangling"))
    for i in range(rounds):
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).withColumn("one", F.lit(1))
        got = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        ranks = (
            ranks.select("id", "dangling").join(got, "id", "left").withColumn("one", F.lit(1)).join(lost, "one")
            .select("id", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(n, 1))).alias("rank"), "dangling")
        )
        if i % CUT_EVERY == CUT_EVERY - 1:
            ranks = settle(ranks)
    return ranks.select("id", "rank")


def hits(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``id, hub, authority``: both from the round before, length 1."""
    edges = settle(edges)
    state = nodes.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority"))
    for i in range(rounds):
        a = edges.join(state.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        h = edges.join(state.select(F.col("id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("h"))
        raw = nodes.join(a, "id", "left").join(h, "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("h", F.lit(0.0)).alias("h")).withColumn("one", F.lit(1))
        size = raw.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("sa"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("sh")).withColumn("one", F.lit(1))
        state = raw.join(size, "one").select("id", F.coalesce(F.try_divide("h", "sh"), F.lit(0.0)).alias("hub"), F.coalesce(F.try_divide("a", "sa"), F.lit(0.0)).alias("authority"))
        if i % CUT_EVERY == CUT_EVERY - 1:
            state = settle(state)
    return state


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id a node is connected with.

    Large-star and small-star rounds, which halve path lengths and keep the
    number of edges; the end is seen from counts alone.
    """
    e = settle(undirected(edges))
    while True:
        two = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = two.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = two.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        low2 = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(low2, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("a"), F.col("m").alias("b")), F.struct(F.col("src").alias("a"), F.col("m").alias("b")))).alias("x")).select(
            F.least("x.a", "x.b").alias("src"), F.greatest("x.a", "x.b").alias("dst")).where("src <> dst").distinct()
        after = settle(small)
        if after.count() == e.count() and after.join(e, ["src", "dst"], "left_anti").isEmpty():
            break
        e = after
    named = after.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("component"))
    return nodes.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def depths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``id, depth``: links from the nearest start, level by level."""
    edges = settle(simple_edges(edges))
    seen = settle(starts.select("id", F.lit(0).alias("depth")).distinct())
    front, d = seen, 0
    while True:
        d += 1
        found = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        front = settle(found)
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front)) if d % CUT_EVERY == 0 else seen.unionByName(front)
    return seen


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, triangles, coefficient``. Edges point from the end of smaller
    degree to the other, which bounds the wedges of a hub."""
    u = undirected(edges)
    deg = both_ways(edges).groupBy("src").agg(F.count("*").alias("deg"))
    d1, d2 = deg.select(F.col("src"), F.col("deg").alias("a")), deg.select(F.col("src").alias("dst"), F.col("deg").alias("b"))
    o = settle(u.join(d1, "src").join(d2, "dst").select(
        F.when((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("src") < F.col("dst"))), F.struct(F.col("src").alias("x"), F.col("dst").alias("y"))).otherwise(F.struct(F.col("dst").alias("x"), F.col("src").alias("y"))).alias("e")).select("e.*"))
    wedge = o.select("x", F.col("y").alias("y1")).join(o.select("x", F.col("y").alias("y2")), "x").where("y1 < y2")
    closed = wedge.join(u.select(F.col("src").alias("y1"), F.col("dst").alias("y2")), ["y1", "y2"])
    per = closed.select(F.explode(F.array("x", "y1", "y2")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    pairs = F.col("deg") * (F.col("deg") - 1) / 2
    return nodes.join(deg.withColumnRenamed("src", "id"), "id", "left").join(per, "id", "left").select(
        "id", F.coalesce("t", F.lit(0)).alias("triangles"), F.round(F.coalesce(F.try_divide(F.coalesce("t", F.lit(0)), pairs), F.lit(0.0)), 6).alias("coefficient"))


def cascade(nodes: DataFrame, edges: DataFrame, failed: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``id, round`` at which a node fails: once the share of failed among its
    in-neighbours reaches ``threshold``; the first fail at round 0."""
    edges = settle(simple_edges(edges))
    need = edges.groupBy("dst").agg(F.count("*").alias("k"))
    down = settle(failed.select("id", F.lit(0).alias("round")).distinct())
    r = 0
    while True:
        r += 1
        hit = edges.join(down.select(F.col("id").alias("src")), "src").groupBy("dst").agg(F.count("*").alias("f")).join(need, "dst")
        new = settle(hit.where(F.col("f") / F.col("k") >= threshold).select(F.col("dst").alias("id")).join(down.select("id"), "id", "left_anti").withColumn("round", F.lit(r)))
        if new.isEmpty():
            break
        down = settle(down.unionByName(new))
    return down


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, level`` by peeling nodes without open predecessors; nodes on or
    behind a cycle have none."""
    left = settle(simple_edges(edges))
    open_nodes, done, level = settle(nodes.select("id").distinct()), None, 0
    while True:
        free = settle(open_nodes.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        done = settle(done) if level % CUT_EVERY == CUT_EVERY - 1 else done
        open_nodes = settle(open_nodes.join(free.select("id"), "id", "left_anti"))
        left = settle(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return done if done is not None else nodes.select("id", F.lit(0).alias("level")).limit(0)


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, closeness``: reached nodes over the sum of distances, both ways
    along edges; 0 for isolated nodes. The state has a row for each connected
    pair, so it is for graphs of a bounded number of nodes."""
    e = settle(both_ways(edges))
    seen = settle(nodes.select(F.col("id").alias("root"), "id").withColumn("d", F.lit(0)))
    front, d = seen, 0
    while True:
        d += 1
        new = e.join(front.select("root", F.col("id").alias("src")), "src").select("root", F.col("dst").alias("id")).distinct()
        front = settle(new.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front)) if d % CUT_EVERY == 0 else seen.unionByName(front)
    return seen.groupBy(F.col("root").alias("id")).agg(F.round(F.coalesce(F.try_divide(F.count("*") - 1, F.sum("d")), F.lit(0.0)), 6).alias("closeness"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``id, community`` by label propagation: each node takes the label most
    frequent among its neighbours and itself, the smallest on ties."""
    e = settle(both_ways(edges))
    labels = settle(nodes.select("id", F.col("id").alias("community")))
    for i in range(rounds):
        seen = e.join(labels.select(F.col("id").alias("src"), "community"), "src").select(F.col("dst").alias("id"), "community").unionByName(labels)
        votes = seen.groupBy("id", "community").agg(F.count("*").alias("k"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("k")).alias("k"), "community")).alias("b"))
        new = settle(best.select("id", F.col("b.community").alias("community")))
        same = new.join(labels.withColumnRenamed("community", "old"), "id").where("community <> old").isEmpty()
        labels = new
        if same:
            break
    return labels
