"""Depths, strongly connected components and shortest cycles of edges(project, src, dst), with work that grows with the edges.

No table of reachable pairs is made.  Chains, in which one step is all that can follow, are contracted by pointer jumping in
about log2(length) joins, but only where many rounds have not got to an end: what is left is peeled level by level.  The
tables of a round are staged.  Project and nodes are not null; repeated edges count once; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.sources.staging import stage

ENDLESS = float("inf")


def _plain(edges: DataFrame) -> DataFrame:
    return stage(edges.select("project", "src", "dst").distinct(), "edges")


def _named(nodes: DataFrame, name: str, *more: Column) -> DataFrame:
    """nodes(project, node, ...) with another name for node, for a join."""
    return nodes.select("project", F.col("node").alias(name), *more)


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that have both ends among nodes(project, node)."""
    return edges.join(_named(nodes, "src"), ["project", "src"], "left_semi").join(_named(nodes, "dst"), ["project", "dst"], "left_semi")


def followed(links: DataFrame) -> DataFrame:
    """links(project, node, to, a, b), one a node, followed to their ends by doubling: to is then a node without a link, or
    null where the links run into a ring.

    A link says value(node) = max(a, b + value(to)), and so does what comes back.  last is the last node of the way that has
    a link, low the smallest node of the way (of the ring, if all of the way is one).
    """
    here = stage(links.withColumns({"last": F.col("node"), "low": F.col("node"), "more": F.lit(True)}), "links")
    for _ in range(here.count().bit_length() + 1):
        then = here.select("project", F.col("node").alias("to"), *[F.col(c).alias(f"_{c}") for c in ("to", "a", "b", "last", "low")], F.lit(True).alias("_more"))
        both = here.join(then, ["project", "to"], "left")
        here = stage(
            both.select(
                "project",
                "node",
                F.coalesce("_to", "to").alias("to"),
                F.greatest("a", F.col("b") + F.col("_a")).alias("a"),
                (F.col("b") + F.coalesce("_b", F.lit(0.0))).alias("b"),
                F.coalesce("_last", "last").alias("last"),
                F.least("low", "_low").alias("low"),
                F.coalesce("_more", F.lit(False)).alias("more"),
            ),
            "links",
        )
        if here.filter("more").isEmpty():
            break
    return here.withColumn("to", F.when(~F.col("more"), F.col("to"))).drop("more")


def depth(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """project, node, depth: the longest path from each node to a leaf; infinite where a cycle can be reached.

    A round takes the depths settled last into the nodes right above, and settles those that have got one from each of their
    edges.  Of the others it keeps how many they have got, and the greatest, their floor; nodes not met yet have no row.  So
    a round reads the edges once, with the few rows that are new.  Where a round settles nothing, each node that is left
    leads to others that are left, so into a cycle.

    After so many rounds (a quarter as many from then on) only the edges of what is left are kept.  Where far more nodes
    wait for one other node, these are contracted: their depth is max(floor, weight + depth of that node), which composes
    along a chain; they are filled in at the end, the last ones first.
    """
    open_edges = _plain(edges).withColumn("w", F.lit(1.0))
    nodes = open_edges.select("project", F.col("src").alias("node"), F.lit(0.0).alias("floor")).distinct()
    leaves = open_edges.select("project", F.col("dst").alias("node")).distinct().join(nodes, ["project", "node"], "left_anti")
    done = stage(leaves.withColumn("depth", F.lit(0.0)), "settled")
    settled, rings, chains = [done], [], []
    while True:
        counted = stage(open_edges.join(open_edges.groupBy("project", "src").agg(F.count(F.lit(1)).alias("n")), ["project", "src"]), "counted")
        waits = nodes.filter("floor > 0").withColumns({"got": F.lit(0).cast("bigint"), "n": F.lit(None).cast("bigint")})
        for _ in range(rounds):
            step = counted.join(_named(done, "dst", "depth"), ["project", "dst"])
            step = step.select("project", F.col("src").alias("node"), (F.col("w") + F.col("depth")).alias("floor"), F.lit(1).cast("bigint").alias("got"), "n")
            waits = stage(waits.unionByName(step).groupBy("project", "node").agg(F.max("floor").alias("floor"), F.sum("got").alias("got"), F.max("n").alias("n")), "waits")
            done = waits.filter("got = n").select("project", "node", F.col("floor").alias("depth"))
            waits = waits.filter("n is null or got < n")
            settled.append(done)
            if not (n_done := done.count()):
                break
        known = reduce(DataFrame.unionByName, settled)
        left = nodes.join(known, ["project", "node"], "left_anti")
        if not n_done:
            settled.append(left.select("project", "node", F.lit(ENDLESS).alias("depth")))
            break
        # Edges into what was settled last stay: the next round takes them.
        taken = known.join(done, ["project", "node"], "left_anti")
        open_edges = counted.drop("n").join(_named(left, "src"), ["project", "src"], "left_semi").join(_named(taken, "dst"), ["project", "dst"], "left_anti")
        open_edges = stage(open_edges, "rest")
        ways = open_edges.groupBy("project", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("dst", "w")).alias("_next"))
        floors = waits.select("project", "node", F.col("floor").alias("_floor"))
        state = ways.join(nodes, ["project", "node"]).join(floors, ["project", "node"], "left")
        state = stage(state.select("project", "node", F.greatest("floor", "_floor").alias("floor"), "n", F.col("_next.dst").alias("to"), F.col("_next.w").alias("w")), "state")
        rounds = max(rounds // 4, 1)
        if state.filter("n = 1").count() <= 8 * n_done:
            nodes = state.select("project", "node", "floor")
            continue
        many = state.filter("n > 1").select("project", "node", "floor")
        ends = followed(state.filter("n = 1").select("project", "node", "to", F.col("floor").alias("a"), F.col("w").alias("b")))
        # Rings stay out of what is settled, with the edges into them: what waits for them is left at the end.
        rings.append(ends.filter("to is null").select("project", "node", F.lit(ENDLESS).alias("depth")))
        chains.append(ends.filter("to is not null"))
        short = open_edges.join(_named(many, "src"), ["project", "src"], "left_semi").join(_named(chains[-1], "dst", "to", "a", "b"), ["project", "dst"], "left")
        short = stage(short.select("project", "src", F.coalesce("to", "dst").alias("dst"), (F.col("w") + F.coalesce("b", F.lit(0.0))).alias("w"), (F.col("w") + F.col("a")).alias("floor")), "short")
        open_edges = short.groupBy("project", "src", "dst").agg(F.max("w").alias("w"))
        more = short.groupBy("project", F.col("src").alias("node")).agg(F.max("floor").alias("_floor"))
        nodes = stage(many.join(more, ["project", "node"], "left").select("project", "node", F.greatest("floor", "_floor").alias("floor")), "nodes")
    out = reduce(DataFrame.unionByName, settled + rings)
    for ends in reversed(chains):
        out = stage(out, "depths")
        filled = ends.join(_named(out, "to", "depth"), ["project", "to"]).select("project", "node", F.greatest("a", F.col("b") + F.col("depth")).alias("depth"))
        out = out.unionByName(filled)
    return out


def _peeled(edges: DataFrame) -> DataFrame:
    """The edges that another edge leads to and another one goes on from."""
    starts = edges.select("project", F.col("src").alias("dst")).distinct()
    ends = edges.select("project", F.col("dst").alias("src")).distinct()
    return edges.join(starts, ["project", "dst"], "left_semi").join(ends, ["project", "src"], "left_semi")


def _passes(edges: DataFrame) -> DataFrame:
    """links of the nodes that one edge leads to and one edge leaves."""
    ends = edges.select("project", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("dst").alias("to"))
    ends = ends.unionByName(edges.select("project", F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(None).cast(edges.schema["dst"].dataType).alias("to")))
    both = ends.groupBy("project", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("to").alias("to"))
    return both.filter("o = 1 and i = 1").select("project", "node", "to", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))


def _contracted(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """project, src, dst, w, key: edges between nodes that are in no chain; key is the last node of the chain they stand for."""
    outer = edges.join(_named(chains, "src"), ["project", "src"], "left_anti")
    both = outer.join(_named(chains, "dst", "to", "b", "last"), ["project", "dst"], "left")
    return both.select("project", "src", F.coalesce("to", "dst").alias("dst"), (F.lit(1.0) + F.coalesce("b", F.lit(0.0))).alias("w"), F.col("last").alias("key"))


def _coloured(edges: DataFrame, nodes: DataFrame, most: float) -> DataFrame | None:
    """project, node, color: the smallest node that leads to the node, or the node itself; None after too many rounds.

    Each round takes the colours of the nodes before, then the colours of the colours, so long ways are crossed in leaps.
    """
    colors, n = stage(nodes.select("project", "node", F.col("node").alias("color")), "colors"), 0
    while n < most:
        n += 1
        before = edges.join(_named(colors, "src", "color"), ["project", "src"]).groupBy("project", F.col("dst").alias("node")).agg(F.min("color").alias("_color"))
        near = colors.join(before, ["project", "node"], "left").withColumn("_near", F.least("color", "_color")).drop("_color")
        far = near.join(colors.select("project", F.col("node").alias("_near"), F.col("color").alias("_far")), ["project", "_near"])
        new = stage(far.select("project", "node", F.least("_near", "_far").alias("color"), (F.col("color") != F.least("_near", "_far")).alias("_new")), "colors")
        colors = new.drop("_new")
        if new.filter("_new").isEmpty():
            return colors
    return None


def _rooted(edges: DataFrame, most: float) -> tuple[DataFrame, DataFrame] | None:
    """project, node, part of the nodes that lead back to the node that gave them their colour: its component; and the edges
    inside colours, which no component goes beyond.  None after too many rounds."""
    colors = _coloured(edges, edges.select("project", F.col("src").alias("node")).distinct(), most)
    if colors is None:
        return None
    own = edges.join(_named(colors, "src", "color"), ["project", "src"]).join(_named(colors, "dst", F.col("color").alias("_color")), ["project", "dst"])
    own = stage(own.filter("color = _color").select("project", "src", "dst", F.col("color").alias("part")), "own")
    edge = found = stage(colors.filter("node = color").withColumnRenamed("color", "part"), "rooted")
    n = 0
    while not edge.isEmpty():
        if (n := n + 1) > most:
            return None
        step = own.join(_named(edge, "dst"), ["project", "dst"]).select("project", F.col("src").alias("node"), "part").distinct()
        edge = stage(step.join(found, ["project", "node"], "left_anti"), "frontier")
        found = stage(found.unionByName(edge), "rooted")
    return found, own.drop("part")


def components(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """project, node, cycle of the nodes that lie on cycles: cycle is the smallest node of the strongly connected component.

    Edges that lead nowhere or come from nowhere are peeled off.  Where that stops, colours spread forwards and the components
    of the nodes that gave them are gathered backwards; then the same goes on with what is left inside colours.  Where
    peeling goes slowly for so many rounds, where most nodes pass one edge on to one, or where colours take more rounds than
    that, chains are contracted instead (rings of them are components).  At last the chains are filled in, the last ones first: they belong to the component
    that holds both of their ends.
    """
    all_edges = _plain(edges)
    loops = all_edges.filter("src = dst").select("project", F.col("src").alias("node"))
    here = stage(all_edges.filter("src <> dst"), "rest")
    n, slow, found, levels = here.count(), 0, [], []
    while n:
        before, n_before = here, n
        here = stage(_peeled(here), "peeled")
        n = here.count()
        slow += 5 * n >= 4 * n_before
        if not n or n < n_before and slow < rounds:
            continue
        slow = 0
        passes = stage(_passes(here), "passes")
        n_passes = passes.count()
        inside = _rooted(here, rounds if n_passes else ENDLESS) if n == n_before and 2 * n_passes <= n else None
        if inside:
            found.append(inside[0])
            here = inside[1]
            for end in ("src", "dst"):
                here = here.join(_named(inside[0], end), ["project", end], "left_anti")
            here = stage(here, "rest")
        elif n_passes > 8 * (n_before - n):
            ends = followed(passes)
            short = stage(_contracted(here, ends), "short")
            levels.append((ends, short))
            here = stage(short.filter("src <> dst").select("project", "src", "dst").distinct(), "rest")
        n = here.count()
    parts = reduce(DataFrame.unionByName, found) if found else loops.withColumn("part", F.col("node")).limit(0)
    for ends, short in reversed(levels):
        parts = stage(parts, "part")
        own = short.filter("src = dst").select("project", F.col("src").alias("node")).distinct().join(parts, ["project", "node"], "left_anti").withColumn("part", F.col("node"))
        rings = ends.filter("to is null").select("project", "node", F.col("low").alias("part"))
        parts = stage(parts.unionByName(own).unionByName(rings), "part")
        through = short.filter("key is not null").join(_named(parts, "src", "part"), ["project", "src"]).join(_named(parts, "dst", F.col("part").alias("_part")), ["project", "dst"])
        through = through.filter("part = _part").select("project", F.col("key").alias("last"), "part")
        parts = parts.unionByName(ends.filter("to is not null").join(through, ["project", "last"]).select("project", "node", "part"))
    parts = stage(parts, "part")
    names = parts.groupBy("project", "part").agg(F.min("node").alias("cycle"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = stage(parts.join(names, ["project", "part"]).select("project", "node", "cycle"), "components")
    return several.unionByName(loops.join(several, ["project", "node"], "left_anti").withColumn("cycle", F.col("node")))


def shortest_cycles(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """project, cycle, length, path: for every component a shortest cycle through its smallest node, from that node on; the
    edge from the last node of the path back to the first one closes it.

    Distances from the smallest nodes spread over the contracted edges of the components; each node keeps the smallest
    node before it among those on shortest ways, and the cycle is read backwards along these.
    """
    parts = stage(components(edges) if parts is None else parts, "parts")
    own = _plain(edges).join(_named(parts, "src", "cycle"), ["project", "src"]).join(_named(parts, "dst", F.col("cycle").alias("_cycle")), ["project", "dst"])
    own = stage(own.filter("cycle = _cycle").select("project", "cycle", "src", "dst"), "own")
    passes = _passes(own).join(parts.filter("node = cycle").select("project", "node"), ["project", "node"], "left_anti")
    chains = followed(passes)
    short = _contracted(own, chains).withColumn("before", F.coalesce("key", "src"))
    short = short.groupBy("project", "src", "dst").agg(F.min(F.struct("w", "before", "key")).alias("x")).select("project", "src", "dst", "x.*")
    short = stage(short.join(_named(parts, "src", "cycle"), ["project", "src"]), "short")
    edge = stage(parts.filter("node = cycle").select("project", "cycle", "node", F.lit(0.0).alias("dist")), "frontier")
    best = None  # project, cycle, node, dist, before, src, w, key; the row of the component's smallest node closes the cycle
    while not edge.isEmpty():
        step = short.join(edge.select("project", F.col("node").alias("src"), "dist"), ["project", "src"])
        step = step.select("project", "cycle", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), "before", "src", "w", "key", F.lit(True).alias("new"))
        every = step if best is None else step.unionByName(best.withColumn("new", F.lit(False)))
        # Of equal ones the old row stays: it is no news then.
        every = every.groupBy("project", "cycle", "node").agg(F.min(F.struct("dist", "before", "new", "src", "w", "key")).alias("x")).select("project", "cycle", "node", "x.*")
        every = stage(every, "best")
        best = every.drop("new")
        closed = best.filter("node = cycle").select("project", "cycle", F.col("dist").alias("_closed"))
        edge = every.filter("new and node <> cycle").join(closed, ["project", "cycle"], "left").filter("_closed is null or dist < _closed")
        edge = stage(edge.select("project", "cycle", "node", "dist"), "frontier")
    if best is None:
        kind = edges.schema["src"].dataType
        return parts.select("project", "cycle", F.lit(0).cast("bigint").alias("length"), F.array(F.col("cycle").cast(kind)).alias("path")).limit(0)
    steps = lambda rows: rows.select("project", "cycle", F.col("src").alias("node"), (F.col("dist") - F.col("w")).alias("at"), "dist", "key")
    hops = [stage(steps(best.filter("node = cycle")), "hops")]
    while not (back := hops[-1].filter("node <> cycle").select("project", "cycle", "node")).isEmpty():
        hops.append(stage(steps(best.join(back, ["project", "cycle", "node"])), "hops"))
    way = reduce(DataFrame.unionByName, hops)
    between = way.join(chains.select("project", F.col("last").alias("key"), F.col("node").alias("_node"), "b"), ["project", "key"])
    nodes = way.select("project", "cycle", "node", "at").unionByName(between.select("project", "cycle", F.col("_node").alias("node"), (F.col("dist") - F.col("b")).alias("at")))
    out = nodes.groupBy("project", "cycle").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("x"))
    return out.select("project", "cycle", F.size("x").cast("bigint").alias("length"), F.transform("x", lambda s: s["node"]).alias("path"))
