import numpy as np

from loghelm.llm import nearest as N
from loghelm.llm.nearest import Index, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, key string, cell int, block string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "x", 0.5) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, every=20, most=20):
    """One list a query; rows equal in id and vector count once."""
    good = {(i, tuple(float(np.float32(c)) for c in v)) for i, v in rows
            if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = set()
    for q, a in good:
        if q % every == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:most]
            out |= {(q, k, i, -s) for k, (s, i) in enumerate(near, 1)}
    return out


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.integers(-3, 4, (400, 6)).astype(float).tolist())]  # many ties
    rows += [(1000 + i, rows[20][1]) for i in range(300)] + [rows[20]] * 5 + [(1000, rows[20][1])]
    return rows + [(2000, None), (2020, [0.0] * 6), (2040, [None] * 6), (2060, [float("nan")] * 6), (None, rows[1][1]), (2080, [-0.0] * 6)]


def answers(df):
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_like_brute_force(spark):
    rows = odd_rows()
    assert answers(nearest_neighbours(frame(spark, rows))) == plain(rows)


def test_walk_is_by_falling_sum():
    rng = np.random.default_rng(5)
    index = Index(rng.standard_normal((7, 3)), rng.standard_normal((5, 3)), rng.integers(0, 3, 35))
    q = rng.standard_normal(6)
    sums = (index.first @ q[:3])[:, None] + (index.second @ q[3:])[None, :]
    order = [c for c in np.argsort(-sums.ravel()).tolist() if index.entries[c]]
    assert list(index.walk(q)) == order
    seen = index.visited(q, 12)
    assert index.entries[seen].sum() >= 12 > index.entries[seen[:-1]].sum()


def test_recall_and_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 16)))]
    monkeypatch.setattr(N, "BLOCK_ENTRIES", 64)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 32)
    found = {r[:3:2] for r in answers(nearest_neighbours(frame(spark, rows), least_entries=50, probes=64))}
    true = {r[:3:2] for r in plain(rows)}
    assert len(found) == 3000 and len(found & true) >= 0.93 * len(true)


def test_large_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ENTRIES", 16)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 4)
    rows = odd_rows()
    assert answers(nearest_neighbours(frame(spark, rows), most_centroids=1)) == plain(rows)


def test_few_and_other_rows(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0]), (3, [1.0])]
    assert answers(nearest_neighbours(frame(spark, few))) == plain(few[:3])
    assert nearest_neighbours(frame(spark, few[:1])).collect() == []
    assert nearest_neighbours(frame(spark, [(1, None), (0, [])])).collect() == []
    assert nearest_neighbours(frame(spark, [])).collect() == []


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = {r[:3] for r in answers(nearest_neighbours(table))}
    assert found == {r[:3] for r in plain([(r["vec_id"], r["embedding"]) for r in table.collect()])}
