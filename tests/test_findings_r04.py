"""A test for the finding of round 4 that was right, and for the ways of the code that it led to."""

import numpy as np
import pytest

from memspark.operators import compaction, graph


def shuffled(spark):
    """Bytes that the session's tasks have shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))


def test_f3_rows_are_not_copied_for_the_blocks_that_they_meet(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(3000, 32))
    path = str(tmp_path / "rows")
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").write.parquet(path)
    rows, before = spark.read.parquet(path), shuffled(spark)
    graph.vector_links(rows, 0.5625, block=64).write.parquet(str(tmp_path / "links"))
    assert shuffled(spark) - before < 2 * x.nbytes  # the sample, and each row once
    got = {tuple(r) for r in graph.components(spark.read.parquet(str(tmp_path / "links"))).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.5625, 1))
    assert (u @ u.T >= 0.5625 - 5e-6).sum() == (u @ u.T >= 0.5625).sum()  # none is within rounding
    up = np.arange(len(x))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        up[np.isin(up, (up[i], up[j]))] = min(up[i], up[j])
    assert got == {(k, int(up[k])) for k in set(a.tolist()) | set(b.tolist())}


@pytest.mark.parametrize("rounds", [8, 2, 1])
def test_f3_groups_that_a_wide_cluster_touches_become_one(spark, monkeypatch, rounds):
    e, rng = np.eye(160), np.random.default_rng(6)
    # Forty rows of a cosine of .757 with each other, whose mean is .8735 long; another row has .6558 with each and .7508 with the mean; three rows are near it.
    wide = np.concatenate([[0.87 * e[50 * g] + np.sqrt(1 - 0.87**2) * e[50 * g + 1 + k] for k in range(40)] for g in range(3)])[rng.permutation(120)]
    other = [0.7538 * e[50 * g] + np.sqrt(1 - 0.7538**2) * e[50 * g + 41] for g in range(3)]
    near = [0.93 * other[g] + np.sqrt(1 - 0.93**2) * e[50 * g + 42 + k] for k in range(3) for g in range(3)]
    x = np.concatenate([wide, other, near, rng.normal(size=(150, 160)), np.zeros((2, 160)), wide[:3]])
    found = []
    monkeypatch.setattr(compaction, "components", lambda edges: found.append(c := graph.components(edges)) or c)
    df = spark.createDataFrame([(5 * k + 2, v.tolist()) for k, v in enumerate(x)] + [(1, None)], "id long, vector array<double>").repartition(6)
    got = {r["id"]: (r["cluster"], r["position"], round(r["similarity"], 9)) for r in compaction.greedy_clusters(df, 0.25, rounds=rounds).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    free, want = np.ones(len(u), bool), {}
    for i in range(len(u)):
        if free[i]:
            members, center, free[i] = [i], u[i], False
            for j in range(i + 1, len(u)):
                if free[j] and center @ u[j] >= 0.75:
                    members.append(j)
                    free[j] = False
                    center = u[members].sum(0) / np.linalg.norm(u[members].sum(0))
            if len(members) >= 3:
                want |= {5 * m + 2: (5 * i + 2, k, round(float(center @ u[m]), 9)) for k, m in enumerate(members)}
    assert got == want and [want[5 * k + 2][1] for k in (120, 121, 122)] == [40, 40, 40] and len({c for c, *_ in want.values()}) == 6
    assert any(not c.isEmpty() for c in found[1:])


def test_f3_a_task_holds_few_edges_of_many():
    rng = np.random.default_rng(5)
    joined = graph._Joined()
    edges = [(rng.integers(0, 300, 400), rng.integers(300, 600, 400), rng.random(400) < 0.3) for _ in range(4)]
    for a, b, sure in edges:
        joined.add(a, b, sure)
        joined.reduce()
    out = joined.batch().to_pydict()
    a, b, sure = (np.concatenate(x) for x in zip(*edges, strict=True))

    def labels(pairs):
        up = np.arange(600)
        for i, j in pairs:
            up[np.isin(up, (up[i], up[j]))] = min(up[i], up[j])
        return up

    whole = list(zip(out["a"], out["b"], out["sure"], strict=True))
    trees = labels(zip(a[sure], b[sure], strict=True))
    assert labels((i, j) for i, j, s in whole if s).tolist() == trees.tolist() and sum(out["sure"]) == 600 - len(set(trees.tolist()))
    loose = [tuple(sorted((trees[i], trees[j]))) for i, j, s in whole if not s]
    assert sorted(loose) == sorted({tuple(sorted((trees[i], trees[j]))) for i, j in zip(a[~sure], b[~sure], strict=True) if trees[i] != trees[j]})


def test_f3_too_many_loose_edges_become_sure(monkeypatch):
    monkeypatch.setattr(graph, "LOOSE", 10)
    joined = graph._Joined()
    joined.add(np.arange(20), np.arange(20) + 1, np.zeros(20, bool))
    out = joined.batch().to_pydict()
    assert all(out["sure"]) and sorted(zip(out["b"], out["a"], strict=True)) == [(0, k) for k in range(1, 21)]
