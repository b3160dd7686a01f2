import math

import numpy as np
import pytest

from statetrail.llm.eigen import refined
from statetrail.llm.queries import QUERIES
from statetrail.llm.whitening import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, components=4):
    """vectors: lists of floats that are all usable."""
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes / np.sqrt(values), values


def compare(rows, vectors, ids):
    n, deviation, white, values = plain(vectors)
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(found) == len(rows) == white.size
    for k in range(white.shape[1]):
        own = np.array([found[i, k + 1].whitened for i in ids])
        sign = np.sign(own @ white[:, k])
        assert np.allclose(own * sign, white[:, k], atol=1e-9)
    for i, d in zip(ids, deviation):
        assert (found[i, 1].n, int(found[i, 1].deviation)) == (n, int(d))
    assert {r.identity_error for r in rows}.pop() < 1e-9
    total = np.trace(np.cov(np.unique(np.floor(256 * np.array(vectors, np.float32).astype(float)), axis=0).T, bias=True))
    for k, value in enumerate(values):
        assert math.isclose(found[ids[0], k + 1].explained, value / total, rel_tol=1e-9)


def test_the_query_equals_a_plain_version(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    rows = QUERIES["op11_embedding_whitening"](spark, sf_dir).collect()
    compare(rows, table["embedding"].tolist(), table["vec_id"].tolist())


def test_unusable_vectors_go_and_repeated_ones_are_fitted_once(spark):
    rng = np.random.default_rng(3)
    good = [[float(v) for v in row] for row in rng.normal(size=(40, 5))]
    good += [good[0]] * 30 + [[v + 1e-4 / 256 for v in good[1]]]
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [1.0, math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0, 0.0]]
    rows = [(i, v, 7) for i, v in enumerate(good)] + [(100 + i, v, 7) for i, v in enumerate(bad)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, x long").repartition(5)
    compare(whitening(docs).collect(), good, list(range(len(good))))


def test_null_ids_repeated_rows_and_negative_zero(spark):
    docs = spark.createDataFrame([(None, [0.0, 1.0]), (1, [-0.0, 1.0]), (1, [-0.0, 1.0]), (2, [3.0, 5.0])], SCHEMA)
    rows = whitening(docs).collect()
    assert sorted((r.vec_id or -1, r.component, r.n) for r in rows) == [(-1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert {round(abs(r.whitened), 9) for r in rows} == {1.0}


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, [])]])
def test_nothing_to_scale_gives_no_rows(spark, rows):
    assert whitening(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_unequal_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="unequal length, 1 to 2"):
        whitening(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def test_entries_of_any_size_have_an_exact_deviation(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.5e12, 7.0])]
    found = {r.vec_id: int(r.deviation) for r in whitening(spark.createDataFrame(
        rows, "vec_id long, embedding array<double>")).collect()}
    x = [[int(256 * v) for v in row] for _, row in rows]
    sums = [sum(c) for c in zip(*x)]
    assert found == {i + 1: sum((3 * v - s) ** 2 for v, s in zip(row, sums)) for i, row in enumerate(x)}


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 30), np.repeat([5.0, 3, 1], 10), np.ones(12), [4.0, 3, 2, 0, 0, 0],
    [10, 10 - 1e-9, 10 - 2e-9, 1 + 1e-12, 1, 0.5], [1e9, 1.0, 1e-3]])
def test_refined_eigenvectors(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(d, d)))
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, x = refined(matrix)
    scale = max(values)
    assert np.allclose(found, np.sort(np.linalg.eigvalsh(matrix))[::-1], rtol=0, atol=1e-14 * scale)
    assert np.abs(x.T @ x - np.eye(d)).max() < 2e-15
    assert np.abs(matrix @ x - x * found).max() < 4e-15 * scale
    assert (np.diff(found) <= 0).all()


def test_float32_alone_is_far_off():
    rng = np.random.default_rng(9)
    matrix = np.cov(rng.normal(size=(64, 500)))
    rough = np.linalg.eigh(matrix.astype(np.float32))[1].astype(float)
    _, x = refined(matrix)
    assert np.abs(rough.T @ rough - np.eye(64)).max() > 1e-8 > 1e6 * np.abs(x.T @ x - np.eye(64)).max()
    assert not refined(np.zeros((3, 3)))[0].any()
