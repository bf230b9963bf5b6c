"""Similarity kernels against products of whole matrices."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtide.functions import vectors as V
from loomtide.operators.groups import groups


def made(spark, n, seed, width=8, kind="float"):
    """Vectors with many exact copies, and their matrix in double precision."""
    v = np.random.default_rng(seed).normal(size=(n, width))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype("f4" if kind == "float" else "f8")
    v[::7] = v[0]
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], f"id long, vector array<{kind}>"), np.round(v.astype("f8") @ v.astype("f8").T, 6)


def best(sim, top):
    s = sim.copy()
    np.fill_diagonal(s, -np.inf)
    near = np.lexsort((np.broadcast_to(np.arange(len(s)), s.shape), -s), axis=1)[:, :top]
    return {(i, int(j), s[i, j]) for i in range(len(s)) for j in near[i]}


@pytest.mark.parametrize("top", [5, 50])
def test_a_row_comes_with_its_best_only(spark, top):
    df, sim = made(spark, 5000, 1)
    got = [tuple(r) for r in V.similar(df, df, top=top).collect()]
    assert len(got) == 5000 * top and set(got) == best(sim, top)


def test_two_sides_and_a_threshold(spark):
    (a, _), (b, _) = made(spark, 700, 2), made(spark, 3000, 3, kind="double")
    x, y = (np.array([r.vector for r in df.orderBy("id").collect()], "f8") for df in (a, b))
    sim = np.round(x @ y.T, 6)
    sim[np.arange(700), np.arange(700)] = -np.inf
    near = V.similar(a, b, threshold=0.5)
    assert {tuple(r) for r in near.collect()} == {(int(i), int(j), sim[i, j]) for i, j in zip(*np.nonzero(sim >= 0.5))}
    nth = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))
    got = V.similar(a, b, threshold=0.5, top=3).withColumn("n", nth).where("n <= 3").drop("n").collect()
    ranked = np.lexsort((np.broadcast_to(np.arange(3000), sim.shape), -sim), axis=1)[:, :3]
    assert {tuple(r) for r in got} == {(i, int(j), sim[i, j]) for i in range(700) for j in ranked[i] if sim[i, j] >= 0.5}


def test_odd_vectors(spark):
    rows = [(1, [1e20, 0.0]), (2, [1e20, 1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [-3.0, 0.0]), (None, [1.0, 1.0]), (6, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    assert {tuple(r) for r in V.similar(df, df, threshold=1e39).collect()} == {(1, 2, 1e40), (2, 1, 1e40)}
    small = df.where("id in (4, 5, 2)")  # similarities under -2 count as well
    assert {(r.left_id, r.right_id) for r in V.similar(small, small, top=2).collect()} == {(2, 4), (2, 5), (4, 2), (4, 5), (5, 2), (5, 4)}
    assert V.similar(df.where("id > 9"), df, top=2).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        V.similar(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema), df, top=1).collect()


def test_pairs_come_once(spark):
    df, sim = made(spark, 3000, 4)
    want = sorted((int(i), int(j), sim[i, j]) for i, j in zip(*np.nonzero(sim >= 0.6)) if i < j)
    assert sorted(tuple(r) for r in V.similar_pairs(df, 0.6).collect()) == want


def shuffled(spark, df) -> int:
    """Bytes that the exchanges of a query wrote."""
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    df.collect()
    while nodes:
        p = nodes.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(p.plan())
            continue
        if p.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleBytesWritten").value()
        nodes += [p.children().apply(k) for k in range(p.children().size())]
    return total


def test_pairs_of_blocks_are_not_shuffled(spark):
    df, _ = made(spark, 5000, 5)
    assert shuffled(spark, V.similar(df, df, top=5)) == 0
    assert shuffled(spark, V.similar_pairs(df, 0.9)) == 0


def test_ties_are_few_and_tie_the_same_groups(spark):
    df, sim = made(spark, 3000, 6)
    at = 0.93
    edges = V.ties(df, at)
    rows = edges.collect()
    assert len(rows) < np.count_nonzero(np.triu(sim >= at, 1)) / 4
    label = np.arange(3000)
    i, j = np.nonzero(np.triu(sim >= at, 1))
    while not np.array_equal(label[i], label[j]):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
    alone = set(range(3000)) - set(i.tolist()) - set(j.tolist())
    assert 100 < len(set(label.tolist())) and alone
    assert {(r.node, r.merge_group) for r in groups(edges).collect()} == {(k, int(label[k])) for k in range(3000) if k not in alone}
