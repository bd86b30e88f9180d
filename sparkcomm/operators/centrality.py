"""Centrality of group networks, for many networks at once.

A network is ``(network_id, source, target, value)`` over its groups. Powers of the network
matrix are taken by repeated squaring, so a power iteration of 2**k steps costs k join-and-aggregate
rounds instead of 2**k. Shortest paths go hop by hop over the links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

ID = "network_id"


def _product(a: DataFrame, b: DataFrame, how: str = "sum") -> DataFrame:
    """Matrix product per network; ``how="min"`` is the min-plus product."""
    left = a.select(ID, F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(ID, F.col("i").alias("k"), F.col("j"), F.col("v").alias("y"))
    cell = F.min(F.col("x") + F.col("y")) if how == "min" else F.sum(F.col("x") * F.col("y"))
    return left.join(right, [ID, "k"]).groupBy(ID, "i", "j").agg(cell.alias("v"))


def _scaled(m: DataFrame) -> DataFrame:
    top = m.groupBy(ID).agg(F.max("v").alias("_m")).where("_m > 0")
    return m.join(top, ID).withColumn("v", F.col("v") / F.col("_m")).drop("_m")


def _edges(net: DataFrame) -> DataFrame:
    return net.where(F.col("value") > 0).select(ID, F.col("source").alias("i"), F.col("target").alias("j"), F.col("value").alias("v"))


def _nodes(net: DataFrame) -> DataFrame:
    return net.select(ID, F.explode(F.array("source", "target")).alias("group")).distinct()


def strengths(net: DataFrame) -> DataFrame:
    """Row and column sums."""
    ends = net.select(
        ID,
        F.inline(
            F.array(
                F.struct(F.col("source").alias("group"), F.col("value").alias("o"), F.lit(0.0).alias("i")),
                F.struct(F.col("target").alias("group"), F.lit(0.0).alias("o"), F.col("value").alias("i")),
            )
        ),
    )
    return ends.groupBy(ID, "group").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def pagerank(net: DataFrame, *, alpha: float = 0.85, squarings: int = 7) -> DataFrame:
    """Weighted PageRank; a group without outgoing links spreads evenly."""
    nodes = _nodes(net)
    count = nodes.groupBy(ID).agg(F.count(F.lit(1)).alias("n"))
    out = _edges(net).groupBy(ID, "i").agg(F.sum("v").alias("_out"))
    start = nodes.select(ID, F.col("group").alias("i")).join(out, [ID, "i"], "left").join(count, ID)
    cells = start.join(nodes.withColumnRenamed("group", "j"), ID).join(_edges(net), [ID, "i", "j"], "left")
    share = F.when(F.col("_out").isNull(), 1.0 / F.col("n")).otherwise(F.coalesce("v", F.lit(0.0)) / F.col("_out"))
    m = cells.select(ID, "i", "j", (F.lit(alpha) * share + F.lit(1 - alpha) / F.col("n")).alias("v"))
    for _ in range(squarings):
        m = materialize(m)
        m = _product(m, m)
    # every row has converged to the stationary distribution
    return m.groupBy(ID, F.col("j").alias("group")).agg(F.avg("v").alias("pagerank"))


def hits(net: DataFrame, *, squarings: int = 7) -> DataFrame:
    """Hub and authority scores, each summing to 1; zeros without links."""
    edges = materialize(_edges(net))
    flipped = edges.select(ID, F.col("j").alias("i"), F.col("i").alias("j"), "v")
    m = _product(edges, flipped)
    for _ in range(squarings):
        m = materialize(_scaled(m))
        m = _product(m, m)
    hub = m.groupBy(ID, F.col("i").alias("group")).agg(F.sum("v").alias("h"))
    hub = hub.withColumn("hub", F.col("h") / F.sum("h").over(Window.partitionBy(ID))).drop("h")
    hub = materialize(hub)
    auth = edges.join(hub, (edges[ID] == hub[ID]) & (edges["i"] == hub["group"])).groupBy(edges[ID], F.col("j").alias("group"))
    auth = auth.agg(F.sum(F.col("v") * F.col("hub")).alias("a"))
    auth = auth.withColumn("authority", F.col("a") / F.sum("a").over(Window.partitionBy(ID))).drop("a")
    return _nodes(net).join(hub, [ID, "group"], "left").join(auth, [ID, "group"], "left").fillna(0.0, ["hub", "authority"])


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b))


def _distances(loops: DataFrame, edges: DataFrame) -> DataFrame:
    """(network, i, j, v): length of the shortest path. Only entries that got shorter are carried along the links, so a hop costs
    at most links x sources rows."""
    d = frontier = loops
    while True:
        step = frontier.select(ID, "i", F.col("j").alias("k"), F.col("v").alias("x")).join(edges.select(ID, F.col("i").alias("k"), "j", F.col("v").alias("w")), [ID, "k"])
        both = d.select(ID, "i", "j", "v", F.col("v").alias("old")).unionAll(step.select(ID, "i", "j", (F.col("x") + F.col("w")).alias("v"), F.lit(None).cast("double").alias("old")))
        d = materialize(both.groupBy(ID, "i", "j").agg(F.min("v").alias("v"), F.min("old").alias("old")))
        frontier = d.where("old IS NULL OR v < old")
        if frontier.isEmpty():
            return d.drop("old")


def _waves(start: DataFrame, links: DataFrame, value: Column) -> DataFrame:
    """Sum over all hops of what ``start`` (network, i, k, c) sends along the links (network, i, k, j), a wave of at most
    nodes x sources rows a hop; ``value`` is what a link passes on."""
    waves, last = [start], start
    while True:
        last = materialize(last.join(links, [ID, "i", "k"]).groupBy(ID, "i", "j").agg(F.sum(value).alias("c")).withColumnRenamed("j", "k"))
        if last.isEmpty():
            break
        waves.append(last)
    total = waves[0]
    for wave in waves[1:]:
        total = total.unionAll(wave)
    return total.groupBy(ID, "i", "k").agg(F.sum("c").alias("c"))


def betweenness(net: DataFrame) -> DataFrame:
    """Share of shortest paths through each group, link strength taken as length, normalised.

    Path counts go forward over the links that lie on shortest paths of a source, and the shares of the paths beyond a group
    come back over the same links, for all sources and networks at once. No triple of groups is formed.
    """
    nodes = materialize(_nodes(net))
    size = nodes.groupBy(ID).agg(F.count(F.lit(1)).alias("n"))
    loops = nodes.select(ID, F.col("group").alias("i"), F.col("group").alias("j"), F.lit(0.0).alias("v"))
    edges = materialize(_edges(net).where("i <> j"))
    d = _distances(loops, edges)
    from_ = d.select(ID, "i", F.col("j").alias("k"), F.col("v").alias("dik"))
    link = from_.join(edges.select(ID, F.col("i").alias("k"), "j", F.col("v").alias("w")), [ID, "k"]).join(d.withColumnRenamed("v", "dij"), [ID, "i", "j"])
    tight = materialize(link.where(_close(F.col("dik") + F.col("w"), F.col("dij"))).select(ID, "i", "k", "j"))
    paths = materialize(_waves(loops.select(ID, "i", F.col("j").alias("k"), F.lit(1.0).alias("c")), tight, F.col("c")))
    # a group's share of the paths to the one after it
    ends = paths.select(ID, "i", F.col("k").alias("j"), F.col("c").alias("cj"))
    share = tight.join(paths, [ID, "i", "k"]).join(ends, [ID, "i", "j"]).select(ID, "i", F.col("j").alias("k"), F.col("k").alias("j"), (F.col("c") / F.col("cj")).alias("share"))
    share = materialize(share)
    first = share.groupBy(ID, "i", "j").agg(F.sum("share").alias("c")).withColumnRenamed("j", "k")
    beyond = _waves(first, share, F.col("c") * F.col("share")).where("i <> k")
    through = beyond.groupBy(ID, F.col("k").alias("group")).agg(F.sum("c").alias("b"))
    scale = F.when(F.col("n") > 2, 1.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    out = nodes.join(through, [ID, "group"], "left").join(size, ID)
    return out.select(ID, "group", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def centrality_network(net: DataFrame) -> DataFrame:
    """All measures per network and group."""
    h = hits(net).select(ID, "group", F.col("hub").alias("influencer"), "authority")
    b = betweenness(net).withColumnRenamed("betweenness", "mediator")
    keys = [ID, "group"]
    return strengths(net).join(b, keys).join(h, keys).join(pagerank(net), keys)


def signaling_role_table(
    net: DataFrame, *, roles: Sequence[str] = ("sender", "receiver", "mediator", "influencer"), normalize: bool = True
) -> DataFrame:
    """``(network_id, role, group, value)``; ``normalize`` divides by the role's largest value."""
    known = {"sender": "outgoing", "receiver": "incoming", "mediator": "mediator", "influencer": "influencer"}
    unknown = [r for r in roles if r not in known]
    if unknown:
        raise ValueError(f"Unknown roles: {unknown}.")
    table = strengths(net)
    if "mediator" in roles:
        table = table.join(betweenness(net).withColumnRenamed("betweenness", "mediator"), [ID, "group"])
    if "influencer" in roles:
        table = table.join(hits(net).select(ID, "group", F.col("hub").alias("influencer")), [ID, "group"])
    rows = F.array(*[F.struct(F.lit(r).alias("role"), F.col(known[r]).cast("double").alias("value")) for r in roles])
    long = table.select(ID, "group", F.inline(rows))
    if not normalize:
        return long
    top = F.max("value").over(Window.partitionBy(ID, "role"))
    return long.withColumn("value", F.when(top > 0, F.col("value") / top).otherwise(F.col("value")))
