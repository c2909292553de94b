import random
import re
from collections import Counter

import numpy as np

from loghelm.llm.quality_rules import Forest, judge_quality, threshold

SF = "/root/testdata/sf0.001"


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = Counter(zip(w, w[1:], w[2:])), [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            covered[i:i + 3] = [True] * 3
    repeat = sum(covered)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat,
            len(w) < 50 or 100 * repeat > 50 * len(w))


def test_rules_like_brute_force(docs, rows, labels):
    found = judge_quality(docs, labels, trees=20).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r)[:7] for r in found), key=key) == sorted(((r[0], *plain(r[1])) for r in rows), key=key)
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = [r for r in judge_quality(docs, labels).collect() if not r["base_failed"] and r["doc_id"] in known]
    good = [r["kept"] for r in found if known[r["doc_id"]]]
    bad = [r["kept"] for r in found if not known[r["doc_id"]]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.3


def test_repeats_in_one_text():
    rng = random.Random(5)
    from loghelm.llm.text_stats import stats
    from loghelm.llm.words import Texts
    texts = ["a a a a", "a b c x a b c", "\n\n# $", "a\r\na\na\n", *(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(200))]
    raw = [t.encode() for t in texts]
    s = stats(Texts(raw), raw)
    for i, t in enumerate(texts):
        assert tuple(s[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(t)[:5]


def test_forest_paths():
    rng = np.random.default_rng(1)
    rows = rng.normal(0.5, 0.02, (2000, 3))
    forest = Forest(rows, np.zeros(3), np.ones(3), 50, 128, 20, 1)
    assert forest.path(np.full((1, 3), 0.5))[0] > 2 * forest.path(np.array([[0.05, 0.5, 0.95]]))[0]


def test_threshold():
    assert threshold([(100, 0, 50), (200, 1, 10), (900, 999, 0)], 0.01) == 101
    assert threshold([(100, 0, 50), (200, 1, 60), (900, 999, 0)], 0.01) == 201
    assert threshold([(100, 500, 1), (900, 500, 0)], 0.01) == 0


def test_without_labels_or_rows(spark, docs, rows, nothing, labels):
    none = labels.limit(0)
    found = judge_quality(docs, none).collect()
    assert len(found) == len(rows) and all(r["kept"] != r["base_failed"] for r in found)
    assert judge_quality(nothing, labels).collect() == []
