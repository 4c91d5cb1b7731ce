"""Cycle removal and levels against reachability by brute force, by both ways of running."""

import random

import pytest

from repoweave.operators import graph


def brute(edges):
    """Acyclic edges, levels and components of one small graph."""
    plain = {(a, b) for a, b in edges if a != b}
    nodes = {n for e in plain for n in e}
    reach = {n: {b for a, b in plain if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    kept = {(a, b) for a, b in plain if a not in reach[b]}
    level = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in kept:
            level[b] = max(level[b], level[a] + 1)
    scc = {n: min([n, *[m for m in reach[n] if n in reach[m]]]) for n in nodes}
    return kept, level, scc


def graphs():
    rng = random.Random(3)
    named = {
        "chain": [("a", "b"), ("b", "c"), ("c", "d")],
        "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
        "two": [("a", "b"), ("b", "a")],
        "tail": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a")],
        "shared": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")],
        "loop": [("a", "a"), ("a", "b")],
        "only loop": [("a", "a")],
        "two cycles in a row": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")],
    }
    for i in range(250):
        n = rng.randint(2, 9)
        names = [f"n{j}" for j in range(n)]
        named[f"random{i}"] = list({(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(1, 2 * n))})
    return named


@pytest.fixture(scope="module")
def case(spark):
    all_graphs = graphs()
    rows = [(repo, a, b) for repo, edges in all_graphs.items() for a, b in edges]
    edges = spark.createDataFrame(rows, "repo_name string, src string, dst string")
    kept, levels, sccs = set(), set(), set()
    for repo, part in all_graphs.items():
        k, lv, sc = brute(part)
        kept |= {(repo, a, b) for a, b in k}
        levels |= {(repo, n, x) for n, x in lv.items()}
        sccs |= {(repo, n, x) for n, x in sc.items()}
    return edges, kept, levels, sccs


@pytest.mark.parametrize("local_edges", [200_000, 10, 0])
def test_against_brute_force(spark, case, local_edges):
    edges, kept, levels, sccs = case
    assert sorted(tuple(r) for r in graph.break_cycles(edges, local_edges).collect()) == sorted(kept)
    assert sorted(tuple(r) for r in graph.node_levels(edges, local_edges).collect()) == sorted(levels)
    assert sorted(tuple(r) for r in graph.components(edges, local_edges).collect()) == sorted(sccs)


def test_hot_target_is_spread(spark, case, monkeypatch):
    """With a tiny limit every popular file counts as hot; the rows stay the same."""
    from repoweave.operators import joins

    edges, kept, *_ = case
    monkeypatch.setattr(joins.hot_keys, "__defaults__", (1,))
    monkeypatch.setattr(joins.salted_join, "__defaults__", ("inner", 1, None, None))
    assert sorted(tuple(r) for r in graph.break_cycles(edges, 0).collect()) == sorted(kept)


def test_isolated_nodes_are_at_level_zero(spark):
    nodes = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "repo_name string, rel_path string")
    edges = spark.createDataFrame([("r", "a", "b")], "repo_name string, src string, dst string")
    assert {tuple(r) for r in graph.topo_levels(nodes, edges).collect()} == {("r", "a", 0), ("r", "b", 1), ("r", "c", 0)}


def test_levels_refuse_a_cycle(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a")], "repo_name string, src string, dst string")
    with pytest.raises(ValueError):
        graph._levels_distributed(edges)


def test_local_step_is_linear_in_depth():
    import time

    import numpy as np

    n = 200_000
    chain = np.arange(n - 1), np.arange(1, n)
    ring = np.arange(n), (np.arange(n) + 1) % n
    started = time.process_time()
    assert graph._longest_paths(*chain, n)[-1] == n - 1
    assert not graph._inside_cycles(*chain, n)[0].any()
    assert graph._inside_cycles(*ring, n)[0].all() and not graph._smallest_members(*ring, n).any()
    assert time.process_time() - started < 20


@pytest.mark.parametrize("bound", [0, 100_000])
def test_large_repositories_with_and_without_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "BROADCAST_REPOS", bound)
    edges = spark.createDataFrame([("a", "x", "y"), ("a", "y", "z"), ("b", "p", "q"), ("b", "q", "p")], "repo_name string, src string, dst string")
    assert {tuple(r) for r in graph.break_cycles(edges, local_edges=0).collect()} == {("a", "x", "y"), ("a", "y", "z")}
    small, large = graph._split_by_size(edges.union(edges.filter("repo_name = 'a'")), 6, 3)
    assert {r.repo_name for r in small.collect()} == {"b"} and {r.repo_name for r in large.collect()} == {"a"}


def counted_rounds(monkeypatch):
    """How often rows are written between rounds."""
    calls = []

    def counting(original):
        def write(df, **metrics):
            calls.append(1)
            return original(df, **metrics)

        return write

    for name in ("shared_checkpoint", "shared_table"):
        monkeypatch.setattr(graph, name, counting(getattr(graph, name)))
    return calls


def edge_table(spark, edges):
    return spark.createDataFrame([("r", f"{a:05}", f"{b:05}") for a, b in edges], "repo_name string, src string, dst string")


def test_long_ring_and_paths_take_few_rounds(spark, monkeypatch):
    """A ring of 1,500 files, and two rings joined by long paths there and back, the smallest file being inside a path."""
    ring = [(i, (i + 1) % 1500) for i in range(1500)]
    one, two = range(2000, 2300), range(3000, 3200)
    rings = [(x, r[(i + 1) % len(r)]) for r in (one, two) for i, x in enumerate(r)]
    there = [(2000, 4000), *((i, i + 1) for i in range(4000, 4200)), (4200, 3000)]
    back = [(3100, 1900), *((i, i + 1) for i in range(1900, 1950)), (1950, 2150)]
    alone = [(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5000), (5002, 5004)]
    calls = counted_rounds(monkeypatch)
    found = {r.rel_path: r.scc_id for r in graph.components(edge_table(spark, ring + rings + there + back + alone), local_edges=0).collect()}
    assert len(calls) < 60
    expected = {f"{i:05}": "00000" for i in range(1500)} | {"05000": "05000", "05001": "05000", "05002": "05000", "05003": "05003", "05004": "05004"}
    assert found == expected | {f"{i:05}": "01900" for i in [*one, *two, *range(1900, 1951), *range(4000, 4201)]}


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(2000)]
    side = [(100, 5000), (5000, 5001), (5001, 1500), (0, 2000)]
    calls = counted_rounds(monkeypatch)
    levels = {r.rel_path: r.level for r in graph._levels_distributed(edge_table(spark, chain + side)).collect()}
    assert len(calls) < 30
    assert levels == {f"{i:05}": i for i in range(2001)} | {"05000": 101, "05001": 102}


def test_rounds_hold_no_node_that_nobody_imports(spark, monkeypatch):
    """Half of the nodes of a tree stay at level 0: their edges count once, and the rounds carry neither."""
    table, rounds = graph.shared_table, []

    def recorded(df, **metrics):
        out = table(df, **metrics)
        if "moved" in df.columns:
            rounds.append({r.node for r in out[0].collect()})
        return out

    monkeypatch.setattr(graph, "shared_table", recorded)
    tree = [(i, i // 2) for i in range(2, 64)]
    levels = {r.rel_path: r.level for r in graph._levels_distributed(edge_table(spark, tree)).collect()}
    assert levels == {f"{i:05}": 6 - i.bit_length() for i in range(1, 64)}
    assert rounds and all(nodes == {f"{i:05}" for i in range(1, 32)} for nodes in rounds)


def test_levels_refuse_cycles_of_both_kinds(spark):
    for edges in ([(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 1), (3, 1), (4, 2)]):
        with pytest.raises(ValueError):
            graph._levels_distributed(edge_table(spark, edges)).collect()
