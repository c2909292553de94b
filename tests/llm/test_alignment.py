import os
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loghelm.llm import alignment as L

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(BYTE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE)
TOKENS_A = {i: t for t, i in A.get_vocab().items()}


def tokens(text):
    """(id, bytes) of A and of B."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out_a = [(i, bytes(byte[c] for c in TOKENS_A[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    out_b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        out_b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    return out_a, out_b


def plain(rows):
    linked, totals = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            a, b = [], []
        spans = [[], []]
        for side, listed in enumerate((a, b)):
            end = 0
            for i, raw in listed:
                spans[side].append((end, end + len(raw), i))
                end += len(raw)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(a) < 3000 else slow(spans)
        cuts = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups, low = [], 0
        for cut in cuts if len(a) < 3000 else []:
            groups.append("|".join(",".join(str(s[2]) for s in side if low < s[1] <= cut) for side in spans))
            low = cut
        linked.append((doc_id, len(a), len(b), len(cuts), links, sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        totals.update(links)
    most = {}
    for (_, b), n in totals.items():
        most[b] = max(most.get(b, 0), n)
    return Counter((i, a, b, g, len(k), sum(totals[p] == most[p[1]] for p in k), sum(totals[p] for p in k), h) for i, a, b, g, k, h in linked)


def slow(spans):
    out, j = [], 0
    for s, e, i in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            out.append((i, spans[1][k][2]))
            k += 1
    return out


def answers(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "   a   b   c   ", "a\n b", "a \n b", "x\n \nfoo", "bar\n\n foo", "tab\t\tx", " nb  sp",
    "x　 y 　z", "<|endoftext|> <s> </s> <unk> <0x0A>", "naïve café ß ﬁ é İ", "日本語。テスト 中文", "🙂👨‍👩‍👧 🙂", "\u0000 a\u0000b", "▁ ▁▁ a▁b",
    "don't WE'LL I'm 's", "x" * 700, "1234567 89.0 --- ...", "​﻿ x", "a\u001c b \u0085c", "line\r\nline  \r\n  end",
]


def test_like_brute_force(spark):
    rng = random.Random(8)
    words = ["the", "reading", "Über", "tokenisation", "xqzw", "don't", "日本", "12,345", "\n", "", "é"]
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [rows[30]] * 3 + [(None, rows[31][1]), (rows[32][0], "other text"), (777, " ".join(rng.choice(words[:5]) for _ in range(20_000)))]
    frame = spark.createDataFrame([(i, t, "x", 1, "x") for i, t in rows], "doc_id long, text string, chunk string, pair int, told string").repartition(3)
    want = plain(rows)
    blank = lambda c: Counter({(*k[:7], "" if k[0] == 777 else k[7]): n for k, n in c.items()})
    for size in (1, 3000, 1 << 22):
        assert blank(answers(L.align_tokens(frame, chunk_bytes=size))) == blank(want)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000")
    assert answers(L.align_tokens(docs)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_no_rows_and_bytes_that_are_no_text(spark, nothing):
    assert L.align_tokens(nothing).collect() == []
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'ff41' AS STRING) AS text")
    assert list(answers(L.align_tokens(odd))) == [(1, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t 　\u001cab'.,1Zé中▁")), max_size=24))
def test_units_keep_the_ids(text):
    units = L.units_of(text) if text else []
    assert " ".join(units) == text
    if text:
        assert sum((A.encode(" " + u, add_special_tokens=False).ids for u in units), []) == A.encode(" " + text, add_special_tokens=False).ids
        if "▁" in text:  # stands for a space in B, so no ids give its bytes back and the text has no tokens
            assert b"".join(t for _, t in tokens(text)[1]) != (" " + text).encode()
        else:
            assert sum((B.encode(u) for u in units), []) == B.encode(text)


def test_units_encoded_in_a_row():
    rng = random.Random(4)
    units = ["a", "the", "x  y", "end ", "", "\nline", "▁", "t▁", "日本", "é.", "x\n", "ab" * 40, "\u0000", "1,2"] + ["w%d" % i for i in range(300)]
    units = list(dict.fromkeys(rng.sample(units, len(units))))
    for own in (L.Units(L.ByteTokens(open(BYTE, encoding="utf-8").read())), L.Units(L.PieceTokens(open(PIECE, "rb").read()))):
        for some in (units[:100], units[100:]):
            own.learn(some, *L.in_rows(some))
        alone = own.tokenizer.encode(units)
        for i, (unit, ids) in enumerate(zip(units, alone)):
            assert own.of(np.array([i])).tolist() == ids
            assert own.right[i] == (b"".join(own.tokenizer.bytes[k] for k in ids) == b" " + unit.encode())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, unique=True), st.lists(st.integers(0, 200), min_size=1), st.randoms(use_true_random=False))
def test_gallop(listed, wanted, rng):
    listed = np.array(sorted(listed))
    low = np.array([rng.randrange(len(listed)) for _ in wanted])
    high = np.array([rng.randint(int(x) + 1, len(listed)) for x in low])
    wanted = np.minimum(np.array(wanted), listed[high - 1])
    guess = np.array([rng.randrange(-5, 250) for _ in wanted])
    want = [next(k for k in range(a, b) if listed[k] >= w) for w, a, b in zip(wanted, low, high)]
    assert L.gallop(wanted, guess, listed, low, high).tolist() == want
