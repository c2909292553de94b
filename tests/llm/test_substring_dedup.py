import hashlib
import random

import numpy as np

from loghelm.llm.substring_dedup import remove_repeats
from loghelm.llm.words import Texts

SF = "/root/testdata/sf0.001"

LAST = 2**63


def brute(rows, width=13):
    words = [(LAST if i is None else i, (t or "").encode().split()) for i, t, *_ in rows]
    first, where = {}, {}
    for k, (i, w) in enumerate(words):
        for p in range(len(w) - width + 1):
            s = tuple(w[p:p + width])
            first[s] = min(first.get(s, LAST), i)
    out = []
    for k, (i, w) in enumerate(words):
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < i:
                gone[p:p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        level, size = 0, width
        while size <= len(w):
            if size not in where:
                where[size] = {}
                for j, (_, v) in enumerate(words):
                    for p in range(len(v) - size + 1):
                        where[size].setdefault(hash(tuple(v[p:p + size])), set()).add(j)
            if not any(len(where[size][hash(tuple(w[p:p + size]))]) > 1 for p in range(len(w) - size + 1)):
                break
            level, size = size, 2 * size
        out.append((None if i == LAST else i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), level))
    return sorted(out, key=str)


def test_like_brute_force(docs, rows):
    few = [r for r in rows if len(r[1] or "") < 100_000]
    found = remove_repeats(docs.where("text is null or length(text) < 100000"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(few)


def test_long_copies_meet_at_high_levels(docs, rows):
    found = {r["doc_id"]: r for r in remove_repeats(docs.where("length(text) > 100000")).collect()}
    a, b = sorted(found)
    assert found[a]["n_removed"] == 0 and found[b]["n_removed"] == 30_000
    assert found[b]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[a]["longest_repeat"] == found[b]["longest_repeat"] == 13 * 2**11


def test_no_rows(nothing):
    assert remove_repeats(nothing).collect() == []


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    first = {}
    for i, t in sorted(rows):
        w = t.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p:p + 13]), i)
    found = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs).collect()}
    for i, t in rows:
        w, gone = t.split(), set()
        for p in range(len(w) - 12):
            if first[tuple(w[p:p + 13])] < i:
                gone.update(range(p, p + 13))
        assert found[i] == len(gone)


def test_codes_tell_words_apart():
    rng = random.Random(1)
    words = list({bytes(rng.randrange(33, 127) for _ in range(rng.randint(1, 12))) for _ in range(50_000)} | {b"y" * 700_000})
    t = Texts([b" ".join(words), b"\x0b\f " + words[0] + b"\r" + words[1], b""])
    for seed in (0, 1):
        code = t.codes(seed)
        assert len(np.unique(code[:len(words)])) == len(words)
        assert code[len(words):].tolist() == code[:2].tolist()
    assert np.diff(t.first).tolist() == [len(words), 2, 0]
