"""Clustering of groups that are too large for a matrix of distances."""

import numpy as np
import pytest

from tallyloom.operators import clustering as cl


@pytest.mark.parametrize("seed", range(12))
def test_vectors_give_the_clusters_of_distances(seed):
    rng = np.random.default_rng(seed)
    dims, n = rng.integers(3, 20), rng.integers(20, 150)
    centres = rng.normal(size=(rng.integers(2, 12), dims))
    v = centres[rng.integers(0, len(centres), n)] + rng.uniform(0.1, 1.2) * rng.normal(size=(n, dims))
    v[n // 2 : n // 2 + 4] = v[3]  # copies
    v[5] = 0
    d = cl.distances(v)
    assert np.array_equal(cl.best_cut(d), cl.Vectors(v).best_cut(np.arange(n)))
    assert np.array_equal(cl.cluster(d), cl.Vectors(v).cluster(cl.ClusterParams()))


@pytest.mark.parametrize("stage", ["first", "full"])
def test_large_groups_are_clustered(spark, sf_dir, stage):
    """A group beyond max_items was refused."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = lambda p: sorted(tuple(r) for r in cl.cluster_groups(e, "label", "vec_id", stage=stage, p=p).collect())
    assert rows(cl.ClusterParams(max_items=5)) == rows(cl.ClusterParams())


def test_rounds_ask_few_rows_again_and_silhouettes_keep_the_nearest(monkeypatch):
    """Before, each link of a chain asked all rows, and each cut's silhouettes all items."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 12))
    asked, real = [], cl._nearest
    monkeypatch.setattr(cl, "_nearest", lambda mean, rows: asked.append(len(rows)) or real(mean, rows))
    large = cl.Vectors(v)
    got, want = large.linkage(np.arange(700)), cl.linkage(cl.distances(v))
    assert [m[1:] for m in got] == [m[1:] for m in want] and np.allclose([m[0] for m in got], [m[0] for m in want])
    assert len(asked) > 3 and sum(asked) < 4 * 700
    near: dict = {}
    for th in cl.THRESHOLDS:
        labels = cl.cut(got, 700, th)
        if 1 < labels.max() + 1 < 700:
            s = large.silhouette(np.arange(700), labels, near)
            assert s == pytest.approx(cl.silhouette(cl.distances(v), labels)) and s == pytest.approx(large.silhouette(np.arange(700), labels))


def test_a_cluster_that_all_others_are_nearest_to_needs_no_round_for_each(monkeypatch):
    v = np.concatenate([np.eye(301)[:, :1] * 3 + np.eye(301) * np.linspace(0.1, 2, 301)[:, None]])
    rounds, real = [], cl._nearest
    monkeypatch.setattr(cl, "_nearest", lambda *a: rounds.append(1) or real(*a))
    got, want = cl.Vectors(v).linkage(np.arange(301)), cl.linkage(cl.distances(v))
    assert np.allclose([m[0] for m in got], [m[0] for m in want]) and len(rounds) < 20
