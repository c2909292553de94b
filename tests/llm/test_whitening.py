import numpy as np
import pytest

from loghelm.llm.whitening import bidiagonal, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, key string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, components=16):
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for _, v in kept]
    fit = np.array(sorted(set(x)), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array((fit * n - s) / n, float)
    e, comp = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)
    e, comp = e[order], comp[:, order]
    k = int((e[:components] > 1e-12 * e.sum()).sum())
    out = []
    for (i, _), row in zip(kept, x):
        row = np.array(row, dtype=object)
        out.append((i, n, int(((n * row - s) ** 2).sum()), (np.array(row - s / n, float) @ comp[:, :k]) / np.sqrt(e[:k])))
    return out, e[:k] / e.sum()


def check(found, rows, components=16):
    want, explained = plain(rows, components)
    assert len(found) == len(want) * len(explained)
    got = {}
    for r in found:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    sign = {}
    for i, n, deviation, whitened in want:
        for c, value in enumerate(whitened, 1):
            mine = got[i, deviation][c]
            assert mine[0]["n"] == n and mine[0]["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            assert mine[0]["identity_error"] < 1e-9
            if abs(value) > 1e-3:
                sign.setdefault(c, np.sign(value * mine[0]["whitened"]))
            assert any(abs(m["whitened"] * sign.get(c, 1) - value) < 1e-6 for m in mine)


def test_like_eigenvectors(spark):
    rng = np.random.default_rng(1)
    spread = rng.standard_normal((300, 24)) * np.linspace(3, 0.3, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(spread)]
    rows += [(1000 + i, rows[5][1]) for i in range(400)] + [(5, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, [None] + [0.0] * 23), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (2004, [0.0] * 24)]
    check(whiten(frame(spark, rows)).collect(), rows)


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(whiten(table).collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_few_dimensions_and_no_variance(spark):
    rng = np.random.default_rng(2)
    flat = [(i, [a, 2 * a, b, 1.0]) for i, (a, b) in enumerate(rng.integers(-9, 9, (80, 2)).astype(float).tolist())]
    found = whiten(frame(spark, flat)).collect()
    check(found, flat)
    assert {r["component"] for r in found} == {1, 2}
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whiten(frame(spark, [])).collect() == []


def test_other_lengths_and_large_entries(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(30)] + [(90, [1.0]), (91, [1.0, 2.0, 3.0])]
    check(whiten(frame(spark, rows)).collect(), rows[:30])
    large = [(i, [float(i) * 1e9, 1.0 + i % 3]) for i in range(5)] + [(7, [3.0e38, 0.0])]
    found = whiten(frame(spark, large)).collect()
    assert {r["vec_id"] for r in found} == {0, 1, 2, 3, 4, 7} and all(r["deviation"] is None for r in found if r["vec_id"] == 7)


def test_equal_values_and_many_dimensions():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    g = turn @ np.diag([9.0, 9.0, 9.0, 4.0] + [1.0] * 20 + [0.0] * 6) @ turn.T
    values, right = bidiagonal(lambda w: g @ w, 30, 5)
    assert np.allclose(values[:5] ** 2, [9, 9, 9, 4, 1]) and np.allclose(right.T @ right, np.eye(right.shape[1]))
    assert np.allclose(g @ right[:, :4], right[:, :4] * values[:4] ** 2)
    steps = []
    x = rng.standard_normal((900, 240)) * 0.97 ** np.arange(240)
    values, right = bidiagonal(lambda w: steps.append(1) or x.T @ (x @ w), 240, 8)
    assert np.allclose(values[:8], np.linalg.svd(x)[1][:8], rtol=1e-12) and len(steps) < 240
