"""What the findings of round 3 name."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loghelm.functions import features as fx
from loghelm.functions import text


def test_structured_features_cut_tokens_at_spaces(spark):
    texts = ["", "  ", "\x1c12　 a\x85b 34", "12x 7 ٣٤ x9 9", "Failed  \t 10.0.0.1 port 22\n", "1 2 3", " ÉTÉ 5% \U0001f600", "a", "7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, message string")
    columns = fx.structured_20(F.col("message"))
    plan = df.select(columns[1])._jdf.queryExecution().analyzed().toString()
    assert text.SPACE_CHARS in plan and text.VISIBLE_CHARS not in plan  # that tests some twenty ranges for each character
    for r in df.select("id", *columns).collect():
        t = texts[r["id"]]
        tokens, n = t.split(), max(len(t.split()), 1)
        assert (r["token_count"], r["message_length"]) == (len(tokens), len(t))
        assert r["numeric_token_count"] == sum(all(unicodedata.category(c) == "Nd" for c in w) for w in tokens)
        assert r["special_char_count"] == len(re.findall("[^a-zA-Z0-9]", "".join(tokens)))
        assert r["unique_token_ratio"] == pytest.approx(len(set(tokens)) / n)
        assert r["average_token_length"] == pytest.approx(sum(map(len, tokens)) / n)


def _trees():
    """Two made trees over three features; a leaf has feature -1."""
    import numpy as np
    tree = lambda feature, cut, left, share: {
        "feature": np.array(feature, np.int32), "cut": np.array(cut, float), "left": np.array(left, np.int32),
        "share": np.array(share, float), "gain": np.zeros(len(cut))}
    return [tree([0, 2, -1, -1, -1], [0.5, -1.0, 0, 0, 0], [1, 3, 0, 0, 0], [0, 0, 0.25, 0.5, 1.0]),
            tree([2, -1, 0, -1, -1], [0.0, 0, 0.75, 0, 0], [1, 0, 3, 0, 0], [0, 0.125, 0, 0.5, 0.75]), tree([-1], [0], [0], [0.5])]


def test_forest_walks_equal_rows_once(monkeypatch):
    import numpy as np

    from loghelm.operators.ml.forest import ForestModel
    from loghelm.operators.ml.vectors import Rows
    model, walked = ForestModel(_trees(), 3), []
    walk = ForestModel._walk
    monkeypatch.setattr(ForestModel, "_walk", lambda self, values: walked.append(len(values)) or walk(self, values))
    dense = np.array([[x, 7.0 * i, z] for i, (x, z) in enumerate(
        (x, z) for x in (0.0, 0.5, 0.6, 0.75, 0.8, -3, np.nan, np.inf) for z in (0.0, -1.0, -1.5, -0.5, 1e-9, np.nan, -0.0))])
    dense = np.concatenate([dense] * 40)
    rows = Rows.of([np.flatnonzero(r != 0) for r in dense], [r[r != 0] for r in dense])
    for _ in range(2):
        found = model.score_rows(rows)
        for x, got in zip(dense, found):
            total = 0.0
            for t in model.trees:
                node = 0
                while t["feature"][node] >= 0:
                    node = t["left"][node] + (x[t["feature"][node]] > t["cut"][node])
                total += t["share"][node]
            assert got == pytest.approx(total / 3)
    assert sum(walked) <= 9  # three places among each feature's two cuts
    assert len(model.score_rows(Rows.of([], []))) == 0


def test_csv_files_are_split_where_rows_are_lines(spark, tmp_path):
    from loghelm.sources import readers
    plain, broken, loose = (tmp_path / n for n in ("plain.csv", "broken.csv", "loose.csv"))
    rows = [(str(i), f'say "{i}", {"x" * 80}', "") for i in range(2_000)]
    text_of = "a,b,c\n" + "".join('{},"{}",{}\n'.format(a, b.replace('"', '""'), c) for a, b, c in rows)
    plain.write_text(text_of + "1,short\n1,2,3,4\n\n")
    broken.write_text(text_of + '5,"two\nlines",z\n')
    loose.write_text('a,b,c\n1,p"q,"r\n2,x"y",z\n')  # a lone quote, then a cell over two lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        split, whole = readers.csv_strings(spark, str(plain)), readers.csv_strings(spark, str(broken))
        assert split.rdd.getNumPartitions() > 3 and whole.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, split.collect())) == sorted([*rows, ("1", "short", "")])
        assert sorted(map(tuple, whole.collect())) == sorted([*rows, ("5", "two\nlines", "z")])
        typed = readers.csv_typed(spark, str(plain), split.schema)
        assert typed.rdd.getNumPartitions() > 3 and typed.where("a = 77").first()["b"] == rows[77][1]
        assert not readers.whole_lines(spark, str(loose))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_packing_learns_words_without_a_pass_over_the_known():
    from loghelm.llm.packing import WordIds

    class Known(dict):
        def keys(self):
            raise AssertionError("goes through all known words")

    ids = WordIds.__new__(WordIds)
    ids.cuts, ids.words, ids.parts, seen = True, Known({b"old.": b"\1"}), {}, []
    ids._encode = lambda listed, together: seen.extend(listed) or ids.parts.update((w, w) for w in listed)
    ids.learn({b"old.", b"new."})
    assert sorted(seen) == [b".", b"new"] and ids.words == {b"old.": b"\1", b"new.": b"new."}
