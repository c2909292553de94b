import random
from itertools import combinations

import numpy as np
import xxhash

from loghelm.llm import simhash as S


def plain(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(prints, threshold=2):
    keys = sorted(set(prints.values()))
    value, forest = np.array(keys, np.uint64), list(range(len(keys)))

    def top(i):
        while forest[i] != i:
            i = forest[i]
        return i
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(value ^ value[i]) <= threshold):
            forest[max(top(i), top(int(j)))] = min(top(i), top(int(j)))
    least = {}
    for name, fp in prints.items():
        doc_id = name[0]
        root = top(keys.index(fp))
        least[root] = min((x for x in (least.get(root), doc_id) if x is not None), default=None)
    return {name: least[top(keys.index(fp))] for name, fp in prints.items()}


def test_like_brute_force(docs, rows):
    prints = {(i, k): plain(t) for k, (i, t, *_) in enumerate(rows)}
    want = sorted(str((name[0], f"{fp:016x}", reachable(prints)[name])) for name, fp in prints.items())
    found = S.near_copies(docs).collect()
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in found) == want


def test_every_close_pair_meets():
    rng = random.Random(2)
    for n_blocks in (1, 2, 3):
        base = [rng.getrandbits(64) for _ in range(10)]
        near = [(b, b ^ sum(1 << i for i in rng.sample(range(64), k))) for b in base for k in (0, 1, 2) for _ in range(20)]
        fp = np.array([x for pair in near for x in pair], np.uint64)
        row, anchor, home = S.anchors(fp, n_blocks, 2)
        at, homes = {}, {}
        for r, a, h in zip(row.tolist(), anchor.tolist(), home.tolist()):
            at.setdefault(r, set()).add(a)
            if h:
                assert r not in homes
                homes[r] = a
        for k in range(len(near)):
            assert homes[2 * k] in at[2 * k + 1] and homes[2 * k + 1] in at[2 * k]


def test_code_covers():
    for block, radius in zip(S.blocks(3, 2), (3, 3, 1)):
        value = np.random.default_rng(1).integers(0, 1 << block.n, 500).astype(np.uint64)
        row, word = block.near(value, 0)
        assert row.tolist() == list(range(500))
        assert (np.bitwise_count(word ^ value) <= radius).all() and (block.syndrome(word) == 0).all()


def test_chains_join(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)] + [(500, i) for i in range(501, 540)]
    random.Random(1).shuffle(links)
    found = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100} | {i: 500 for i in range(501, 540)}


def test_crowded_anchor_is_looked_up(spark):
    import pyarrow as pa
    rng = np.random.default_rng(3)
    centre = np.uint64(0x123456789ABCDEF0)
    flips = [sum(1 << i for i in c) for c in combinations(range(46, 64), 4)][:1500]
    fp = np.unique(np.append(centre ^ np.array(flips, np.uint64), centre))
    fp = np.concatenate([fp, rng.integers(0, 1 << 62, 100_001).astype(np.uint64)])
    home = np.ones(len(fp), bool)
    home[1501:] = False
    table = pa.table({"anchor": [np.zeros(len(fp), np.uint64).tobytes()], "fp": [fp.tobytes()], "home": [home.tobytes()]})
    found = S._linked(2)(table)
    small = pa.table({k: [v[0].as_py()[:len(v[0].as_py()) * 1501 // len(fp)]] for k, v in zip(table.column_names, table.columns)})
    assert set(zip(*S._linked(2)(small).to_pydict().values())) <= set(zip(*found.to_pydict().values()))


def test_one_of_each_group_stays(docs, nothing):
    found, stay = S.near_copies(docs), S.keep_one_near(docs)
    assert stay.columns == docs.columns
    groups = {r["component_id"] for r in found.collect()}
    ids = [r["doc_id"] for r in stay.collect()]
    assert len(ids) == len(groups) and set(ids) == groups
    assert S.near_copies(nothing).collect() == [] and S.keep_one_near(nothing).collect() == []
