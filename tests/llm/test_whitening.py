import math

import numpy as np
import pytest

from bizdata.llm import queries, spectral, whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string, v string, id string"


def brute(rows):
    """The same with whole numbers of Python and numpy's eigenvectors."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = {}
    for x in {tuple(x) for _, x in good}:
        sizes[len(x)] = sizes.get(len(x), 0) + 1
    if not sizes:
        return {}, None, None
    dim = max(sizes, key=lambda d: (sizes[d], d))
    good = [(i, x) for i, x in good if len(x) == dim]
    fit = sorted({tuple(x) for _, x in good})
    n, total = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, total, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)), np.array([(n * a - s) / n for a, s in zip(x, total, strict=True)])) for i, x in good]
    return {"n": n, "rows": out, "fit": centred}, values[::-1], axes[:, ::-1]


def made(seed: int, n: int, dim: int):
    rng = np.random.default_rng(seed)
    data = (rng.normal(size=(n, dim)) * np.linspace(3, 0.5, dim)).tolist()
    rows = [(k - 3, v) for k, v in enumerate(data)]
    rows += [(900, data[0]), (0, data[1]), (None, data[2]), (901, None), (902, []), (903, [None, *data[3][1:]]), (904, [float("nan"), *data[3][1:]]),
             (905, [float("inf"), *data[3][1:]]), (906, data[4][:-1]), (907, [3e38, *data[3][1:]])]
    return rows + [(1000 + k, data[5]) for k in range(50)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "?", "?", "?", "?") for i, v in rows], SCHEMA).repartition(3)
    return whitening.whiten(df, **more).collect()


@pytest.mark.parametrize("dim", [1, 5, 20])
def test_against_numpy(spark, dim):
    rows = made(dim, 120, dim)
    got = run(spark, rows)
    want, values, axes = brute([(i, v) for i, v in rows if not v or v[0] != 3e38])
    k = min(16, dim)
    assert len(got) == len(want["rows"]) * k and {r["component"] for r in got} == set(range(1, k + 1))
    assert {r["n"] for r in got} == {want["n"]}
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), int(r["deviation"])) for r in got if r["component"] == 1) == sorted(((i is None, i or 0), d) for i, d, _ in want["rows"])
    for c in range(k):
        share = {r["explained"] for r in got if r["component"] == c + 1}
        assert len(share) == 1 and share.pop() == pytest.approx(values[c] / values.sum(), rel=1e-9)
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1 and r["vec_id"] not in (0, None)}
        theirs = {i: float(x @ axes[:, c]) / math.sqrt(values[c]) for i, _, x in want["rows"] if i not in (0, None)}
        sign = 1 if sum(mine[i] * theirs[i] for i in mine) > 0 else -1
        assert all(mine[i] == pytest.approx(sign * theirs[i], abs=1e-8) for i in mine)
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-10


def test_equal_vectors_have_no_variance(spark):
    got = run(spark, [(k, [0.5, -0.25]) for k in range(6)])
    assert len(got) == 12 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 and r["identity_error"] == 0 for r in got)


def test_fewer_vectors_than_entries(spark):
    got = run(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0])])
    first = {r["vec_id"]: r["whitened"] for r in got if r["component"] == 1}
    assert abs(first[1]) == pytest.approx(1) and first[1] == pytest.approx(-first[2])
    assert all(r["whitened"] is None for r in got if r["component"] > 1) and {round(r["identity_error"], 12) for r in got} == {0.0}


def test_nothing_usable(spark):
    assert run(spark, [(1, None), (2, []), (3, [None])]) == []
    assert run(spark, []) == []


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(k) * 2.0**40, 2.0**53 * (k % 3), 1.0]) for k in range(9)]
    got = {r["vec_id"]: r["deviation"] for r in run(spark, rows) if r["component"] == 1}
    want, _, _ = brute(rows)
    assert {i: d if d < 10**38 else None for i, d, _ in want["rows"]} == {i: None if d is None else int(d) for i, d in got.items()}


@pytest.mark.parametrize("kind", ["random", "low rank", "close", "graded", "blocks"])
def test_spectral_divide_and_conquer(kind):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    spectrum = {"random": rng.random(40), "low rank": np.r_[np.ones(5), np.zeros(35)], "close": 1 + 1e-9 * np.arange(40),
                "graded": np.logspace(0, -15, 40), "blocks": np.repeat([4.0, 3.0, 2.0, 1.0], 10)}[kind]
    a = (turn * spectrum) @ turn.T
    values, vectors = spectral.eigen(a)
    assert np.abs(values - np.sort(spectrum)[::-1]).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 and np.abs(vectors.T @ vectors - np.eye(40)).max() < 1e-13


def test_polar_factor():
    rng = np.random.default_rng(3)
    for a in (rng.normal(size=(12, 12)), np.diag(np.logspace(0, -12, 12)), -np.eye(4)):
        left, _, right = np.linalg.svd(a)
        assert np.abs(spectral.polar(a) - left @ right).max() < 1e-10 / np.linalg.svd(a)[1].min() ** 0.1


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_whitening"](spark, folder)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, values, axes = brute(rows)
    got = got.collect()
    assert len(got) == 16 * len(rows)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d for i, d, _ in want["rows"]}
    for c in range(16):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        theirs = {i: float(x @ axes[:, c]) / math.sqrt(values[c]) for i, _, x in want["rows"]}
        sign = 1 if sum(mine[i] * theirs[i] for i in mine) > 0 else -1
        assert max(abs(mine[i] - sign * theirs[i]) for i in mine) < 1e-8
