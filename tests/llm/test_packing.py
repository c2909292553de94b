import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loghelm.llm.packing import pack_documents, plan

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_uses_up_the_counts(counts):
    patterns, used = plan(counts, 40), Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 40 and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    bins = sum(t for _, t in patterns)
    assert bins <= best_fit(counts, 40) * 1.2 + 1
    assert bins >= -(-sum(k * n for k, n in counts.items()) // 40)


def best_fit(counts, size):
    gaps = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(size - length)
        else:
            gaps[gaps.index(fit)] -= length
    return len(gaps)


def test_exact_fills():
    assert sorted(plan({30: 5, 10: 5}, 40)) == [((30, 10), 5)]
    assert plan({25: 3, 7: 3, 8: 3}, 40)[0][1] == 3
    assert sum(t for _, t in plan({22: 4, 5: 4, 6: 4, 7: 4}, 40)) == 4


def pieces(text, size):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]
    return [(k, a, len(ids[a:a + size]), zlib.crc32(np.array(ids[a:a + size], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), size))]


def test_like_brute_force(docs, rows):
    for size in (64, 2048):
        found = pack_documents(docs, size=size).collect()
        want = Counter((i, *p) for i, t, *_ in rows for p in pieces(t, size))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
        bins = defaultdict(list)
        for r in found:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for placed in bins.values():
            end = 0
            for offset, length in sorted(placed):
                assert offset == end
                end += length
            assert end <= size
        assert len(bins) <= -(-sum(r["length"] for r in found) // size) + 3


def test_odd_words_keep_their_ids(spark):
    texts = ["Ünïcode é é don't WE'LL x<|endoftext|>y <|ENDOFTEXT|>", "İstanbul ΣΑΣ ß### a!!b 12a,b3", "   x​y\x1cz", "日本語。テスト!!", "a" * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in pack_documents(frame).collect()}
    assert found == {(i, p[0]): p[3] for i, t in enumerate(texts) for p in pieces(t, 2048)}


def test_letters_before_marks(spark):
    """Every letter below U+0600 and of the Latin and Greek supplements, before a full stop, a comma and two marks."""
    letters = [chr(c) for c in (*range(0x41, 0x600), *range(0x1E00, 0x2000)) if chr(c).isalpha()]
    texts = [f"{c}. {c}, x{c}?! {c}{c}." for c in letters] + ["İ. İstanbul, ALİ. İ,İ! İİ", "İ"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["ids_crc32"] for r in pack_documents(frame).collect()}
    assert found == {i: pieces(t, 2048)[0][3] for i, t in enumerate(texts)}


def test_the_given_tokenizer_cuts_at_marks():
    from loghelm.llm.packing import WordIds
    assert WordIds(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()).cuts


def test_words_are_whole_where_a_tokenizer_does_not_cut_at_marks():
    from loghelm.llm.packing import WordIds
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = WordIds(open(path, encoding="utf-8").read())
    words = {b"Word.", b"WORD,", "Über!".encode(), b"x"}
    ids.learn(words)
    plain = Tokenizer.from_file(path)
    assert not ids.cuts
    assert all(ids.words[w] == np.array(plain.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words)


def test_no_rows(nothing):
    assert pack_documents(nothing).collect() == []
