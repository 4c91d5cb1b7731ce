"""Cycles and levels of the import graph, for all repositories at once.

Edges are ``(repo_name, src, dst)``, importer to imported. Repositories are split by a checked size: those with at
most ``local_edges`` edges are finished by one grouped task each, after a single shuffle; larger ones go through
DataFrame rounds that never bring a repository together. Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.operators.dependencies import drop_self_loops
from repoweave.operators.joins import hot_keys, salted_join
from repoweave.session import shared_checkpoint, shared_table

# Largest repository a single task may hold: about 50 MB of path pairs.
LOCAL_EDGES = 200_000

# Largest number of repositories whose names are broadcast.
BROADCAST_REPOS = 100_000

EDGE = ["repo_name", "src", "dst"]


def _split_by_size(edges: DataFrame, n: int, local_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of repositories up to the limit, and those above it (None when there are none), of ``n`` edges in all.

    The list of large repositories is broadcast up to a checked number, and joined with salted keys beyond it.
    """
    if n <= local_edges:
        return edges, None
    large, seen = shared_checkpoint(
        edges.groupBy("repo_name").count().filter(F.col("count") > local_edges).select("repo_name"),
        n=F.count(F.lit(1)),
    )
    if seen["n"] == 0:
        return edges, None
    if seen["n"] <= BROADCAST_REPOS:
        return (
            edges.join(F.broadcast(large), "repo_name", "left_anti"),
            edges.join(F.broadcast(large), "repo_name", "left_semi"),
        )
    return (
        salted_join(edges, large, ["repo_name"], ["src"], how="left_anti"),
        salted_join(edges, large, ["repo_name"], ["src"], how="left_semi"),
    )


# ---- repositories that fit one task -------------------------------------------------------------------------


def _adjacency(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Targets of all nodes one after the other, and where those of each node begin."""
    order = np.argsort(src, kind="stable")
    return dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()


def _smallest_members(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's strongly connected component, by one depth-first pass with an explicit stack: time in
    proportion to nodes and edges, whatever the depth."""
    targets, starts = _adjacency(src, dst, n)
    at, found, low = starts[:-1].copy(), [-1] * n, [0] * n
    smallest, open_ = list(range(n)), []
    is_open = [False] * n
    count = 0
    for root in range(n):
        path = [root] if found[root] < 0 else []
        while path:
            node = path[-1]
            if found[node] < 0:
                found[node] = low[node] = count
                count += 1
                open_.append(node)
                is_open[node] = True
            if at[node] < starts[node + 1]:
                target = targets[at[node]]
                at[node] += 1
                if found[target] < 0:
                    path.append(target)
                elif is_open[target]:
                    low[node] = min(low[node], found[target])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[node])
            if low[node] == found[node]:
                members = [open_.pop()]
                while members[-1] != node:
                    members.append(open_.pop())
                least = min(members)
                for member in members:
                    smallest[member] = least
                    is_open[member] = False
    return np.array(smallest, dtype=np.int64)


def _inside_cycles(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of edges whose two ends lie on a common cycle, and the smallest member of each node's component."""
    smallest = _smallest_members(src, dst, n)
    return smallest[src] == smallest[dst], smallest


def _longest_paths(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Edges on the longest path to each node of an acyclic graph: nodes are settled once all edges to them are."""
    targets, starts = _adjacency(src, dst, n)
    waiting = np.bincount(dst, minlength=n).tolist()
    level = [0] * n
    settled = [node for node in range(n) if not waiting[node]]
    for node in settled:
        deeper = level[node] + 1
        for target in targets[starts[node] : starts[node + 1]]:
            if level[target] < deeper:
                level[target] = deeper
            waiting[target] -= 1
            if not waiting[target]:
                settled.append(target)
    return np.array(level, dtype=np.int64)


def _encode(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, pd.Index]:
    codes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True), sort=True)
    return codes[: len(pdf)], codes[len(pdf) :], names


def _local_acyclic(pdf: pd.DataFrame) -> pd.DataFrame:
    src, dst, names = _encode(pdf)
    return pdf[~_inside_cycles(src, dst, len(names))[0]]


def _local_levels(pdf: pd.DataFrame) -> pd.DataFrame:
    src, dst, names = _encode(pdf)
    kept = ~_inside_cycles(src, dst, len(names))[0]
    level = _longest_paths(src[kept], dst[kept], len(names))
    return pd.DataFrame({"repo_name": pdf["repo_name"].iloc[0], "rel_path": names, "level": level})


def _local_components(pdf: pd.DataFrame) -> pd.DataFrame:
    src, dst, names = _encode(pdf)
    smallest = _smallest_members(src, dst, len(names))
    return pd.DataFrame({"repo_name": pdf["repo_name"].iloc[0], "rel_path": names, "scc_id": names[smallest]})


def _local_cycle_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    src, dst, names = _encode(pdf)
    inside, smallest = _inside_cycles(src, dst, len(names))
    return pdf[inside].assign(scc_id=names[smallest[src[inside]]].to_numpy())


# ---- repositories of any size ---------------------------------------------------------------------------------


def _jump(links: DataFrame) -> DataFrame:
    """Follow ``links (repo_name, node, up)``, at most one for each node, to their end.

    Returns ``repo_name, node, top, steps, least, circle``: the node without a link that is reached, the number of links to
    it, and the smallest node on the way; on a circle, ``least`` is the smallest node of it. A round replaces the end of every
    walk by the end of the walk from there, so lengths double and rounds are logarithmic.
    """
    ends = links.select("repo_name", F.col("node").alias("up"), F.lit(True).alias("_more"))
    walks, seen = shared_table(
        salted_join(links, ends, ["repo_name", "up"], ["node"], how="left").select(
            "repo_name", "node", F.col("up").alias("top"), F.lit(1).cast("long").alias("steps"),
            F.least("node", "up").alias("least"), F.coalesce("_more", F.lit(False)).alias("open"),
        ),
        n=F.count(F.lit(1)),
        left=F.count_if("open"),
    )
    rows, left = seen["n"], seen["left"]
    while left:
        on = walks.select(
            "repo_name", F.col("node").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"),
            F.col("least").alias("_least"), F.col("open").alias("_open"),
        )
        further = salted_join(walks.filter("open"), on, ["repo_name", "top"], ["node"], rows=rows).select(
            "repo_name", "node", F.col("_top").alias("top"), (F.col("steps") + F.col("_steps")).alias("steps"),
            F.least("least", "_least").alias("least"), F.col("_open").alias("open"), (F.col("_least") < F.col("least")).alias("_lower"),
        )
        settled = walks.filter("not open").withColumn("_lower", F.lit(False))
        walks, seen = shared_table(settled.unionByName(further), left=F.count_if("open"), lower=F.count_if("_lower"))
        walks = walks.drop("_lower")
        # Walks that end get fewer with every round. Those on a circle stay, and have all of it once nothing gets smaller.
        if seen["left"] == left and not seen["lower"]:
            break
        left = seen["left"]
    return walks.withColumnRenamed("open", "circle")


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace paths through nodes with one edge in and one out by a single edge.

    Returns the edges with the two ends ``a, b`` of their path (an edge beside such nodes is its own path), and edges of whole
    circles of such nodes with the smallest node as ``scc_id``. A path lies on a cycle exactly if its ends do, together.
    """
    ins = edges.groupBy("repo_name", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("before"))
    outs = edges.groupBy("repo_name", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("after"))
    unary = shared_table(ins.join(outs, ["repo_name", "node"]).filter("n_in = 1 and n_out = 1").drop("n_in", "n_out"))
    inner = unary.select("repo_name", F.col("node").alias("before"))
    walks = _jump(unary.join(inner, ["repo_name", "before"]).select("repo_name", "node", F.col("before").alias("up")))
    # A path is known by its first inner node; the last one shows where it ends.
    placed = unary.join(walks, ["repo_name", "node"], "left").select(
        "repo_name", "node", "before", "after", F.coalesce("top", "node").alias("path"), "least", F.coalesce("circle", F.lit(False)).alias("circle")
    )
    placed = shared_table(placed)
    rings = placed.filter("circle").select("repo_name", F.col("node").alias("src"), F.col("after").alias("dst"), F.col("least").alias("scc_id"))
    lines = placed.filter("not circle")
    nodes = lines.select("repo_name", F.col("node").alias("after"))
    first = lines.filter("path = node").select("repo_name", "path", F.col("before").alias("a"))
    last = lines.join(nodes, ["repo_name", "after"], "left_anti").select("repo_name", "path", F.col("after").alias("b"))
    paths = first.join(last, ["repo_name", "path"])
    of_node = lines.join(paths, ["repo_name", "path"]).select("repo_name", "node", "a", "b")
    from_inner = of_node.withColumnRenamed("node", "src").join(lines.select("repo_name", F.col("node").alias("src"), F.col("after").alias("dst")), ["repo_name", "src"])
    into_first = paths.select("repo_name", F.col("a").alias("src"), F.col("path").alias("dst"), "a", "b")
    inner_edges = from_inner.select(*EDGE, "a", "b").unionByName(into_first)
    beside = edges.join(inner_edges.select(*EDGE).unionByName(rings.select(*EDGE)), EDGE, "left_anti")
    beside = beside.select(*EDGE, F.col("src").alias("a"), F.col("dst").alias("b"))
    return inner_edges.unionByName(beside), rings


def _trim(edges: DataFrame, n: int, hot: DataFrame) -> tuple[DataFrame, int]:
    """Drop edges that start at a node nobody imports or end at one that imports nothing; neither is on a cycle.
    Stops when a round removes less than a tenth, since labels cope with the rest."""
    while n:
        ends = edges.select("repo_name", F.col("src").alias("node"), F.lit(1).alias("is_src"), F.lit(0).alias("is_dst"))
        ends = ends.union(edges.select("repo_name", "dst", F.lit(0), F.lit(1)))
        passed = (
            ends.groupBy("repo_name", "node")
            .agg(F.max("is_src").alias("is_src"), F.max("is_dst").alias("is_dst"))
            .filter("is_src = 1 and is_dst = 1")
        )
        kept = edges.join(passed.select("repo_name", F.col("node").alias("src")), ["repo_name", "src"], "left_semi")
        as_dst = passed.select("repo_name", F.col("node").alias("dst"))
        kept = salted_join(kept, as_dst, ["repo_name", "dst"], ["src"], "left_semi", hot=hot, rows=n).select(*EDGE)
        before = n
        edges, seen = shared_checkpoint(kept, n=F.count(F.lit(1)))
        n = seen["n"]
        if n > 0.9 * before:
            break
    return edges, n


def _hop(labels: DataFrame, edges: DataFrame, hot: DataFrame, rows: int) -> DataFrame:
    """Pass the labels of nodes that changed one edge further, in both directions."""
    nothing = F.lit(None).cast("string")
    moved = labels.filter("moved")
    as_src = moved.select("repo_name", F.col("node").alias("src"), "above")
    as_dst = moved.select("repo_name", F.col("node").alias("dst"), "below")
    down = edges.join(as_src, ["repo_name", "src"]).select(
        "repo_name", F.col("dst").alias("node"), "above", nothing.alias("below")
    )
    up = salted_join(edges, as_dst, ["repo_name", "dst"], ["src"], hot=hot, rows=rows).select(
        "repo_name", F.col("src").alias("node"), nothing.alias("above"), "below"
    )
    own = labels.select(
        "repo_name", "node", "above", "below", F.col("above").alias("old_above"), F.col("below").alias("old_below")
    )
    merged = (
        own.unionByName(down, allowMissingColumns=True)
        .unionByName(up, allowMissingColumns=True)
        .groupBy("repo_name", "node")
        .agg(*[F.min(c).alias(c) for c in ("above", "below")], *[F.max(c).alias(c) for c in ("old_above", "old_below")])
    )
    changed = (F.col("above") < F.col("old_above")) | (F.col("below") < F.col("old_below"))
    return merged.select("repo_name", "node", "above", "below", changed.alias("moved"))


def _spread_labels(edges: DataFrame, hot: DataFrame, rows: int) -> DataFrame:
    """Per node the smallest node that reaches it (``above``) and the smallest it reaches (``below``)."""
    ends = edges.select("repo_name", F.col("src").alias("node")).union(edges.select("repo_name", "dst")).distinct()
    labels = shared_checkpoint(
        ends.select(
            "repo_name", "node", F.col("node").alias("above"), F.col("node").alias("below"), F.lit(True).alias("moved")
        )
    )
    while True:
        labels, seen = shared_checkpoint(_hop(labels, edges, hot, rows), n=F.count_if("moved"))
        if seen["n"] == 0:
            return labels


def _inside_branching_cycles(edges: DataFrame, local_edges: int) -> DataFrame:
    """Edges inside a strongly connected component, with the component's smallest node as ``scc_id``, in rounds as many as
    the longest paths have nodes.

    After the labels are stable, two nodes of one component carry the same pair, so edges between different pairs
    are cut. A component whose two labels agree is complete: its label node reaches every member and is reached
    by it. What is left starts over; each pass completes at least one component per connected piece. Trimming
    leaves little of most repositories: those that now fit one task are finished there.
    """
    spark = edges.sparkSession
    edges, seen = shared_checkpoint(edges.select(*EDGE), n=F.count(F.lit(1)))
    # Taken once: later edge sets are subsets, for which these slices are enough.
    hot = shared_checkpoint(hot_keys(edges, ["repo_name", "dst"]))
    found = []
    schema = f"{', '.join(f'{c} string' for c in EDGE)}, scc_id string"
    n = seen["n"]
    while True:
        edges, n = _trim(edges, n, hot)
        if n == 0:
            break
        small, edges = _split_by_size(edges, n, local_edges)
        found.append(small.groupBy("repo_name").applyInPandas(_local_cycle_edges, schema))
        if edges is None:
            break
        labels = _spread_labels(edges, hot, n)
        at_src = labels.select("repo_name", F.col("node").alias("src"), F.col("above").alias("a"), F.col("below").alias("b"))
        at_dst = labels.select("repo_name", F.col("node").alias("dst"), F.col("above").alias("c"), F.col("below").alias("d"))
        both = salted_join(edges.join(at_src, ["repo_name", "src"]), at_dst, ["repo_name", "dst"], ["src"], hot=hot, rows=n)
        same, seen = shared_checkpoint(
            both.filter("a = c and b = d").select(*EDGE, F.col("a").alias("scc_id"), (F.col("a") == F.col("b")).alias("done")),
            n=F.count_if(~F.col("done")),
        )
        found.append(same.filter("done").select(*EDGE, "scc_id"))
        edges, n = same.filter("not done").select(*EDGE), seen["n"]
        if n == 0:
            break
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def _inside_cycles_distributed(edges: DataFrame, local_edges: int) -> DataFrame:
    """Edges inside a strongly connected component, with the component's smallest node as ``scc_id``. What fits one task
    after trimming is finished there; in the rest, paths without branches are contracted first, in logarithmic rounds."""
    edges, seen = shared_checkpoint(edges.select(*EDGE), n=F.count(F.lit(1)))
    hot = shared_checkpoint(hot_keys(edges, ["repo_name", "dst"]))
    edges, n = _trim(edges, seen["n"], hot)
    small, large = _split_by_size(edges, n, local_edges)
    schema = f"{', '.join(f'{c} string' for c in EDGE)}, scc_id string"
    local = small.groupBy("repo_name").applyInPandas(_local_cycle_edges, schema)
    if large is None:
        return local
    contracted, rings = _contract(large)
    contracted = shared_checkpoint(contracted)
    between = contracted.filter("a <> b").select("repo_name", F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    inside = _inside_branching_cycles(between, local_edges)
    of_node = inside.select("repo_name", F.col("src").alias("a"), "scc_id").distinct()
    ends = inside.select("repo_name", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("_inside"))
    joined = contracted.join(of_node, ["repo_name", "a"], "left").join(ends, ["repo_name", "a", "b"], "left")
    found = shared_checkpoint(
        joined.filter("_inside or a = b").select(*EDGE, F.coalesce("scc_id", "a").alias("part"))
    )
    # The smallest node of a component may be one inside a path.
    members = found.select("repo_name", "part", F.col("src").alias("node")).union(found.select("repo_name", "part", "dst"))
    least = members.groupBy("repo_name", "part").agg(F.min("node").alias("scc_id"))
    whole = salted_join(found, least, ["repo_name", "part"], ["src"]).select(*EDGE, "scc_id")
    return local.unionByName(whole).unionByName(rings)


def _acyclic_distributed(edges: DataFrame, local_edges: int) -> DataFrame:
    return edges.join(_inside_cycles_distributed(edges, local_edges), EDGE, "left_anti")


def _levels_distributed(edges: DataFrame) -> DataFrame:
    """Levels of an acyclic edge set, the length of the longest path to each node.

    A node with a single edge to it is one level below the node that it hangs on, so it is left out of the rounds: walks up
    to the first node with another number of edges give its distance, in logarithmic rounds. Between those nodes, levels
    are raised along weighted edges until none changes; a round looks at the nodes that were raised in the one before. A node
    without edges to it stays at level 0, so its edges count once, before the rounds, which hold neither.
    """
    edges, seen = shared_table(edges.select(*EDGE), n=F.count(F.lit(1)))
    node = ["repo_name", "node"]
    ins = edges.groupBy("repo_name", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("up"))
    walks = _jump(ins.filter("n_in = 1").select(*node, "up"))
    if walks.filter("circle").limit(1).count():
        raise ValueError("the edges contain a cycle; remove cycles first")
    hanging = walks.select(*node, "top", "steps")
    met = edges.join(hanging.select("repo_name", F.col("node").alias("dst")), ["repo_name", "dst"], "left_anti")
    from_top = met.join(hanging.withColumnRenamed("node", "src"), ["repo_name", "src"], "left")
    weighted = from_top.groupBy("repo_name", F.coalesce("top", "src").alias("src"), "dst").agg(
        F.max(F.coalesce("steps", F.lit(0)) + 1).alias("weight")
    )
    weighted = shared_table(weighted)
    ends = edges.select("repo_name", F.col("src").alias("node")).union(edges.select("repo_name", "dst")).distinct()
    tops = ends.join(hanging.select(*node), node, "left_anti")
    entered = weighted.groupBy("repo_name", F.col("dst").alias("node")).agg(F.max("weight").alias("level"))
    levels, count = shared_table(entered.select(*node, "level", F.lit(True).alias("moved")), nodes=F.count(F.lit(1)))
    between = weighted.join(levels.select("repo_name", F.col("node").alias("src")), ["repo_name", "src"], "left_semi")
    between, some = shared_table(between, n=F.count(F.lit(1)))
    rounds, moved = 0, some["n"]
    while moved:
        raised = between.join(levels.filter("moved").select("repo_name", F.col("node").alias("src"), "level"), ["repo_name", "src"])
        raised = raised.select("repo_name", F.col("dst").alias("node"), (F.col("level") + F.col("weight")).alias("level"), F.lit(-1).cast("long").alias("old"))
        own = levels.select(*node, "level", F.col("level").alias("old"))
        merged = own.unionByName(raised).groupBy(*node).agg(F.max("level").alias("level"), F.max("old").alias("old"))
        levels, seen = shared_table(merged.select(*node, "level", (F.col("level") > F.col("old")).alias("moved")), n=F.count_if("moved"))
        rounds, moved = rounds + 1, seen["n"]
        if rounds > count["nodes"]:
            raise ValueError("the edges contain a cycle; remove cycles first")
    levels = shared_table(tops.join(levels.select(*node, "level"), node, "left").select(*node, F.coalesce("level", F.lit(0).cast("long")).alias("level")))
    of_top = levels.select("repo_name", F.col("node").alias("top"), "level")
    below = salted_join(hanging, of_top, ["repo_name", "top"], ["node"]).select(*node, (F.col("level") + F.col("steps")).alias("level"))
    return levels.unionByName(below).withColumnRenamed("node", "rel_path")


# ---- public operators -----------------------------------------------------------------------------------------


def _run(edges: DataFrame, local, distributed, schema: str, local_edges: int) -> DataFrame:
    edges, seen = shared_checkpoint(drop_self_loops(edges).select(*EDGE), n=F.count(F.lit(1)))
    small, large = _split_by_size(edges, seen["n"], local_edges)
    solved = small.groupBy("repo_name").applyInPandas(local, schema)
    return solved if large is None else solved.unionByName(distributed(large))


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(repo_name, rel_path, scc_id)`` for every node with an edge; ``scc_id`` is the component's smallest node."""

    def distributed(large: DataFrame) -> DataFrame:
        inside = _inside_cycles_distributed(large, local_edges)
        members = (
            inside.select("repo_name", F.col("src").alias("rel_path"), "scc_id").distinct()
        )
        nodes = large.select("repo_name", F.col("src").alias("rel_path")).union(large.select("repo_name", "dst")).distinct()
        return nodes.join(members, ["repo_name", "rel_path"], "left").withColumn(
            "scc_id", F.coalesce("scc_id", "rel_path")
        )

    schema = "repo_name string, rel_path string, scc_id string"
    return _run(edges, _local_components, distributed, schema, local_edges)


def break_cycles(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Edges without self-loops and without any edge that lies on a cycle."""

    def distributed(large: DataFrame) -> DataFrame:
        return _acyclic_distributed(large, local_edges)

    return _run(edges, _local_acyclic, distributed, "repo_name string, src string, dst string", local_edges)


def node_levels(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(repo_name, rel_path, level)`` for every node with an edge, after cycle removal: the length of the longest
    path from a file that nobody imports."""

    def distributed(large: DataFrame) -> DataFrame:
        # Nodes whose edges all lay on cycles keep level 0.
        nodes = large.select("repo_name", F.col("src").alias("rel_path")).union(large.select("repo_name", "dst")).distinct()
        levels = _levels_distributed(_acyclic_distributed(large, local_edges))
        return nodes.join(levels, ["repo_name", "rel_path"], "left").withColumn(
            "level", F.coalesce("level", F.lit(0).cast("long"))
        )

    schema = "repo_name string, rel_path string, level long"
    return _run(edges, _local_levels, distributed, schema, local_edges)


def topo_levels(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Level of every node of the graph; nodes without edges are at level 0."""
    linked = node_levels(edges, local_edges)
    return nodes.join(linked, ["repo_name", "rel_path"], "left").withColumn(
        "level", F.coalesce("level", F.lit(0).cast("long"))
    )
