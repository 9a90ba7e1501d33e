"""Paths, bridges, trees and contagion on graphs, level by level.

State is a table by node, or by seed and node where a stated set of seeds is
followed at once; fronts are settled each level, and a loop ends when a front is
empty, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.graph import both_ways, simple_edges, undirected
from strandline.session import settle


def hierarchy(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The tree of first discovery: ``id, depth, parent``; of several parents
    of the level above the smallest. Starts have depth 0 and no parent; nodes
    that no start reaches have no row."""
    edges = settle(simple_edges(edges))
    blank = F.lit(None).cast(dict(edges.dtypes)["src"])
    front = settle(starts.where("id IS NOT NULL").select("id", F.lit(0).alias("depth"), blank.alias("parent")).distinct())
    seen, depth = front, 0
    while not front.isEmpty():
        depth += 1
        found = edges.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = settle(found.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"))
        seen = settle(seen.unionByName(front))
    return seen


def betweenness(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id, betweenness`` on the undirected graph from the shortest paths that
    begin at ``seeds`` (all nodes: the full measure, each pair counted twice).

    The seeds are a stated query set. All of them are followed at once: the
    state is one row for each seed and node it reaches, with the number of
    shortest paths; dependencies are summed on the way back.
    """
    e = settle(both_ways(edges))
    front = settle(seeds.where("id IS NOT NULL").select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")).distinct())
    seen, depth = front, 0
    while not front.isEmpty():
        depth += 1
        found = front.join(e.withColumnRenamed("src", "id"), "id").groupBy("seed", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = settle(found.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(depth).alias("depth"), "paths"))
        seen = settle(seen.unionByName(front))
    back = settle(seen.where(f"depth = {depth - 1}").withColumn("dep", F.lit(0.0)))
    total = back
    for level in range(depth - 2, -1, -1):
        above = seen.where(f"depth = {level}")
        below = back.select("seed", F.col("id").alias("dst"), ((1 + F.col("dep")) / F.col("paths")).alias("share"))
        got = above.join(e.withColumnRenamed("src", "id"), "id").join(below, ["seed", "dst"]).groupBy("seed", "id").agg(F.sum(F.col("paths") * F.col("share")).alias("dep"))
        back = settle(above.join(got, ["seed", "id"], "left").select(*seen.columns, F.coalesce("dep", F.lit(0.0)).alias("dep")))
        total = total.unionByName(back)
    own = total.where("seed <> id").groupBy("id").agg(F.sum("dep").alias("betweenness"))
    nodes = e.select(F.col("src").alias("id")).distinct()
    return nodes.join(own, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def bridges(edges: DataFrame) -> DataFrame:
    """Edges whose loss parts a component: ``src, dst``, smaller end first.

    Each component gets a breadth-first tree from its smallest node. An edge
    beside the tree covers the tree path between its ends; the ends climb
    towards each other level by level, all edges at once, and every tree edge
    that is climbed over is no bridge. Edges that meet the same pair of ends on
    the way up are followed once.
    """
    from strandline.operators.graph import components, nodes_of

    u = settle(undirected(edges))
    named = settle(components(nodes_of(u), u))
    tree = settle(hierarchy(both_ways(u), named.where("id = component").select("id")))
    up = settle(tree.where("parent IS NOT NULL").select("id", "parent", "depth"))
    tree_edges = up.select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"), "id")
    depth = tree.select("id", "depth")
    walk = settle(
        u.join(tree_edges.select("src", "dst"), ["src", "dst"], "left_anti")
        .join(depth.select(F.col("id").alias("src"), F.col("depth").alias("da")), "src").join(depth.select(F.col("id").alias("dst"), F.col("depth").alias("db")), "dst")
        .select(F.col("src").alias("a"), F.col("dst").alias("b"), "da", "db"))
    covered = None
    while not walk.isEmpty():
        one = walk.select(F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("low"), F.when(F.col("da") >= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("other"),
                          F.greatest("da", "db").alias("dl"), F.least("da", "db").alias("do"))
        step = settle(one.select("low").distinct())
        covered = step if covered is None else settle(covered.unionByName(step).distinct())
        moved = one.join(up.select(F.col("id").alias("low"), F.col("parent").alias("p")), "low").where("p <> other")
        walk = settle(moved.select(F.least("p", "other").alias("a"), F.greatest("p", "other").alias("b"),
                                   F.when(F.col("p") <= F.col("other"), F.col("dl") - 1).otherwise(F.col("do")).alias("da"), F.when(F.col("p") <= F.col("other"), F.col("do")).otherwise(F.col("dl") - 1).alias("db")).distinct())
    left = tree_edges if covered is None else tree_edges.join(covered.select(F.col("low").alias("id")), "id", "left_anti")
    return left.select("src", "dst")


def debt_rank(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distress from each seed along edges ``src, dst, weight``: ``seed, id,
    distress``; a node is hit once, at the first level that reaches it, by the
    sum of weight and distress of those that hit it, 1 at most."""
    e = settle(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    front = settle(seeds.where("id IS NOT NULL").select(F.col("id").alias("seed"), "id", F.lit(1.0).alias("distress")).distinct())
    seen = front
    while not front.isEmpty():
        hit = front.join(e.withColumnRenamed("src", "id"), "id").groupBy("seed", F.col("dst").alias("id")).agg(F.least(F.lit(1.0), F.sum(F.col("distress") * F.col("weight"))).alias("distress"))
        front = settle(hit.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").where("distress > 0"))
        seen = settle(seen.unionByName(front))
    return seen


def systemic_risk(ranks: DataFrame, n_nodes: int) -> DataFrame:
    """``seed, reached, impact``: how many others a seed reaches and the mean
    distress it spreads over all others."""
    d = ranks.where("seed <> id").groupBy("seed").agg(F.count("*").alias("reached"), F.sum("distress").alias("d"))
    seeds = ranks.select("seed").distinct()
    return seeds.join(d, "seed", "left").select("seed", F.coalesce("reached", F.lit(0)).alias("reached"), (F.coalesce("d", F.lit(0.0)) / max(n_nodes - 1, 1)).alias("impact"))


def eigenvector_centrality(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """``id, centrality``: power iteration on the undirected graph with a part
    of each node's own value, length 1."""
    e = settle(both_ways(edges))
    state = settle(e.select(F.col("src").alias("id")).distinct().withColumn("v", F.lit(1.0)))
    for i in range(rounds):
        got = e.join(state.select(F.col("id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("v").alias("got"))
        raw = state.join(got, "id").select("id", (F.col("v") + F.col("got")).alias("w"))
        size = raw.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
        state = raw.crossJoin(F.broadcast(size)).select("id", (F.col("w") / F.col("size")).alias("v"))  # one row
        if i % 4 == 3:
            state = settle(state)
    return state.withColumnRenamed("v", "centrality")


def epidemic(edges: DataFrame, infected: DataFrame, beta: float, gamma: float, steps: int) -> DataFrame:
    """Mean-field spread over the undirected graph: ``id, s, i, r`` after
    ``steps``; a node escapes infection by each infected neighbour with
    1 - beta times that neighbour's chance of being infected."""
    e = settle(both_ways(edges))
    nodes = e.select(F.col("src").alias("id")).distinct().unionByName(infected.select("id")).distinct()
    state = settle(nodes.join(infected.select("id").distinct().withColumn("hit", F.lit(1.0)), "id", "left").select(
        "id", (1 - F.coalesce("hit", F.lit(0.0))).alias("s"), F.coalesce("hit", F.lit(0.0)).alias("i"), F.lit(0.0).alias("r")))
    for step in range(steps):
        escape = e.join(state.where("i > 0").select(F.col("id").alias("dst"), "i"), "dst").groupBy(F.col("src").alias("id")).agg(F.exp(F.sum(F.log(1 - beta * F.col("i")))).alias("escape"))
        new = F.col("s") * (1 - F.coalesce("escape", F.lit(1.0)))
        state = state.join(escape, "id", "left").select("id", (F.col("s") - new).alias("s"), (F.col("i") * (1 - gamma) + new).alias("i"), (F.col("r") + gamma * F.col("i")).alias("r"))
        if step % 4 == 3:
            state = settle(state)
    return state
