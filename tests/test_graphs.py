"""Graph operators against brute force, and how many tables long graphs write."""

import random

import pytest

from clausula.operators import closure


def components_of(edges):
    """node -> least node of its cyclic component, by reachability."""
    nodes = {x for e in edges for x in e}
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        reach[n] = seen
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


def table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range((30, 45, 60, 90)[seed])]
    at = 100
    for _ in range(6):  # chains and trees into, out of and between parts of the graph, and loops at chains
        a, b = r.randrange(40), r.choice([r.randrange(40), None])
        for _ in range(r.randrange(1, 9)):
            edges.append((a, at))
            if r.random() < 0.2:
                edges.append((at, 1000 + at))
            a, at = at, at + 1
        if b is not None:
            edges.append((a, b))
    assert {x.node: x.component for x in closure.strong_components(table(spark, edges)).collect()} == components_of(edges)


def test_small_shapes(spark):
    for edges in ([], [(1, 1)], [(1, 2), (2, 1), (2, 2)], [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)], [(1, 2), (2, 3)], [(5, 6), (6, 5), (6, 7), (7, 8), (8, 6), (8, 9), (9, 9)]):
        assert {x.node: x.component for x in closure.strong_components(table(spark, edges)).collect()} == components_of(edges)


def test_long_tail_takes_few_rounds(spark, monkeypatch):
    """A ring with a tail of 20,000 nodes with leaves on every tenth: tables grow with the logarithm."""
    n, written, cut = 20_000, [], closure.cut
    monkeypatch.setattr(closure, "cut", lambda df, label="": (written.append(label), cut(df, label))[1])
    from pyspark.sql import functions as F

    tail = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ring = table(spark, [(-1, -2), (-2, -3), (-3, -1), (-3, 0)])
    leaves = spark.range(0, n, 10).select(F.col("id").alias("src"), (F.col("id") + 1_000_000).alias("dst"))
    got = closure.strong_components(tail.unionByName(ring).unionByName(leaves)).collect()
    assert {x.node: x.component for x in got} == {-1: -3, -2: -3, -3: -3}
    assert len(written) < 60


def test_ancestors_have_the_longest_way(spark):
    edges = [(i, i + 1) for i in range(40)] + [(0, 20), (5, 39), (100, 101), (101, 100), (100, 3)]
    got = {(x.node, x.ancestor): x.distance for x in closure.ancestors(table(spark, edges)).collect()}
    assert {k: v for k, v in got.items() if k[0] < 100} == {(a, b): b - a for a in range(41) for b in range(a + 1, 41)}


def test_rounds_go_by_chains_and_not_by_the_table(spark, monkeypatch):
    """One small ring among many nodes: rounds end with the longest chain that ends, and with the least of the rings."""
    from clausula.operators import closure

    written, real = [], closure.cut
    monkeypatch.setattr(closure, "cut", lambda df, label="step": written.append(label) or real(df, label))
    refs = spark.range(2, 1 << 14).selectExpr("id AS src", "CASE WHEN id < 6 THEN id ^ 1 ELSE id - id % 4 END AS dst").where("src <> dst")
    nodes = spark.range(1 << 14).toDF("node")
    got = {r.status: r.n for r in closure.resolve_chain(refs, nodes).groupBy("status").agg({"*": "count"}).toDF("status", "n").collect()}
    assert got["cycle"] == 6 and sum(got.values()) == 1 << 14 and len(written) < 6
    written.clear()
    values = nodes.where("node % 4 = 0").selectExpr("node", "node AS value")
    ends = {r.node: (r.terminal, r.n, r.first) for r in closure.carried(refs, values, nodes).where("node < 13").collect()}
    assert ends[9] == (8, 1, 8) and ends[8] == (8, 1, 8) and ends[5] == (None, None, None) and len(written) < 6
    written.clear()
    rings = spark.range(1 << 12).selectExpr("id AS src", "id - id % 8 + (id + 3) % 8 AS dst").unionByName(spark.range(1 << 12, (1 << 12) + 37).selectExpr("id AS src", "(id - 4096 + 5) % 37 + 4096 AS dst"))
    parts = {r.node: r.component for r in closure.strong_components(rings).collect()}
    assert parts == {i: i - i % 8 for i in range(1 << 12)} | {i: 1 << 12 for i in range(1 << 12, (1 << 12) + 37)}
    assert written.count("passed") < 10
