"""Whitening and clustering of vectors, against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindmill.llm import clustering, whitening
from bindmill.llm.common import read

VECTORS = "vec_id long, embedding array<float>, component string, cluster string, row string, v string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Nulls in every column, short, empty and broken vectors, repeated rows and ties."""
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(0, 0.2, 64)], "a", "b", "c", "d") for i in range(150)]
    rows += [rows[3], rows[3], (3, rows[4][1], "x", "y", "z", None), (None, rows[5][1], None, None, None, None),
             (900, None, None, None, None, None), (901, [], "a", "b", "c", "d"), (902, [1.0, 2.0], "a", "b", "c", "d"),
             (903, [math.nan] + [0.0] * 63, "a", "b", "c", "d"), (904, [math.inf] + [0.0] * 63, "a", "b", "c", "d"),
             (905, [None] + [0.0] * 63, "a", "b", "c", "d"), (906, [1e30] + [0.0] * 63, "a", "b", "c", "d"),
             (907, [-1.0, 1.0] * 32, "a", "b", "c", "d"), (908, [0.0] * 64, "a", "b", "c", "d")]
    return spark.createDataFrame(rows, VECTORS)


def _kept(frame):
    rows = [(r["vec_id"], r["embedding"]) for r in frame.select("vec_id", "embedding").collect()]
    return [(k, v) for k, v in rows if v is not None and len(v) == 64
            and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)]


def _check_whitening(frame, rows):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviations = sorted(int(sum((n * a - s) ** 2 for a, s in zip(line, sums))) for line in x)
    mean = np.array([s / n for s in sums], dtype=float)
    centred = x.astype(float) - mean
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    got = frame.collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == deviations
    for k in range(8):
        mine = np.sort([r["whitened"] for r in got if r["component"] == k + 1])
        plain = np.sort(centred @ axes[:, -1 - k] / np.sqrt(values[-1 - k]))
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain[::-1]).max()) < 1e-8
        share = {r["explained"] for r in got if r["component"] == k + 1}
        assert len(share) == 1 and abs(share.pop() / (values[-1 - k] / np.trace(cov)) - 1) < 1e-9
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-8


def test_whitening_of_edge_rows(vectors):
    _check_whitening(whitening.whiten(vectors), _kept(vectors))


def test_whitening_of_whole_table(spark, small):
    _check_whitening(whitening.op11_feast_whitening(spark, small), _kept(read(spark, small, "embeddings")))


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0], "a", "b", "c", "d")] * 3, VECTORS)
    rows = whitening.whiten(one).collect()
    assert len(rows) == 9 and {r["whitened"] for r in rows} == {None} and {int(r["deviation"]) for r in rows} == {0}
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i], "a", "b", "c", "d") for i in range(5)], VECTORS)
    rows = whitening.whiten(flat).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in rows) and rows[0]["identity_error"] < 1e-9
    none = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns[-6:] == ["component", "n", "deviation", "whitened", "explained",
                                                       "identity_error"]


def test_sums_of_large_numbers_are_exact(spark):
    draw = np.random.default_rng(2)
    rows = draw.integers(-2 ** 50, 2 ** 50, (7, 3))
    exact = [[int(sum(int(a) * int(b) for a, b in zip(rows[:, i], rows[:, j]))) for j in range(3)] for i in range(3)]
    assert whitening.gram(rows).tolist() == exact
    wide = spark.createDataFrame([(i, [float(2 ** 40 - 2 ** 17 * i), 0.5 * i], "a", "b", "c", "d") for i in range(9)],
                                 VECTORS)
    x = [[math.floor(1024.0 * c) + 100_000 for c in r["embedding"]] for r in wide.collect()]
    sums = [sum(c) for c in zip(*x)]
    plain = sorted(sum((9 * a - s) ** 2 for a, s in zip(line, sums)) for line in x)
    got = whitening.whiten(wide).where("component = 1").collect()
    assert sorted(int(r["deviation"]) for r in got) == plain


@pytest.mark.parametrize("matrix", [np.eye(9), np.diag([1.0] * 3 + [2.0] * 6), np.diag([1e6, 1, 1, 1e-3, 0, 0, 0, 0]),
                                    np.ones((12, 12)), np.array([[0.0, 1.0], [1.0, 0.0]])])
def test_components_of_equal_eigenvalues(matrix):
    values, vectors = whitening.leading_components(matrix, 8)
    k = len(values)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-9 * np.abs(matrix).max())
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    for shift in (-0.5, 0.3, 1.5, 7.0):
        assert whitening.inertia_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()


def test_missed_component_is_an_error():
    with pytest.raises(RuntimeError):
        whitening.slice_components(np.diag([3.0, 2.0, 1.0]), 1.5, 3.5, 3)


def _plain_clusters(rows, k=40, rounds=5):
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"2:{'' if rows[i][0] is None else rows[i][0]}".encode())
                                                 .hexdigest(), x[i]))
    centroids = [x[i] for i in order[:k]]

    def assign():
        pairs = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x]
        return [(d.index(min(d)), min(d)) for d in pairs]

    for _ in range(rounds):
        told = assign()
        for c in range(len(centroids)):
            own = [x[i] for i in range(len(x)) if told[i][0] == c]
            if own:
                centroids[c] = [sum(column) // len(own) for column in zip(*own)]
    return assign(), centroids


def _check_clusters(frame, rows):
    told, centroids = _plain_clusters(rows)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for _, d in told)
    own = [sum(d for c, d in told if c == k) for k in range(len(centroids))]
    plain = sorted((-1 if key is None else key, c, d, own[c], total, names[c]) for (key, _), (c, d) in zip(rows, told))
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"],
                  r["inertia"], r["centroid_sha256"]) for r in frame.collect())
    assert got == plain


def test_clusters_of_edge_rows(vectors):
    got = clustering.cluster_vectors(vectors, "vec_id")
    _check_clusters(got, _kept(vectors))
    assert got.columns == ["vec_id", "component", "row", "v", "cluster", "distance", "cluster_inertia", "inertia",
                           "centroid_sha256"]


def test_clusters_of_whole_table(spark, small):
    _check_clusters(clustering.op12_bit_plane_clusters(spark, small), _kept(read(spark, small, "embeddings")))


def test_few_and_no_vectors(spark, vectors):
    few = vectors.where("vec_id in (3, 907, 908, 902)")
    _check_clusters(clustering.cluster_vectors(few, "vec_id"), _kept(few))
    assert clustering.cluster_vectors(vectors.where("false"), "vec_id").count() == 0
    assert clustering.cluster_vectors(vectors.where("vec_id = 902"), "vec_id").count() == 0


def test_bit_planes():
    draw = np.random.default_rng(3)
    for low, high in ((0, 0), (0, 1), (-1, 0), (-256, 255), (-257, 3), (-2 ** 27 + 1, 2 ** 27 - 1)):
        x = draw.integers(low, high + 1, (50, 64))
        x[0], x[1] = low, high
        planes = clustering.plane_count(low, high)
        words = clustering.to_planes(x, planes)
        assert words.shape == (planes, 50) and (clustering.from_planes(words) == x).all()
        assert (clustering.squares(words) == (x * x).sum(axis=1)).all()
        for other in range(4):
            assert (clustering.dots(words, words[:, other]) == x @ x[other]).all()
