"""Packing of documents into sequences of a fixed number of tokens, by exact complements.

Only the counts of pieces by length reach the driver, one number for each length
up to the sequence's. The plan is made on these counts: from the longest length
down, the gap it leaves is filled exactly by a single length, a pair or a triple
looked up by sum, as often as the counts allow; what is left is packed by best
fit. A plan is a list of patterns (lengths, times). Pieces are numbered within
their length, a hot length in many buckets, and a piece's number gives its
pattern, sequence and offset.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, numbered, write_scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# ASCII marks, but for those that begin a contraction or a special token.
MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "'<")
PROBES = ("Word", "WORD", "Über", "ÉTÉ", "naïve", "straße", "слово", "ΛΌΓΟΣ", "x")
WORDS_KEPT = 400_000
_WORKER: dict = {}


def _letters(word: str) -> bool:
    """Whether a word is letters alone, as written and as the tokenizer lower-cases it."""
    return word.isalpha() and unicodedata.normalize("NFC", word.lower()).isalpha()


class WordIds:
    """The ids of words as little-endian bytes, in ``words``; unknown words go through the tokenizer together.

    Words are cut at ASCII white space, which the tokenizer drops and never joins across; a word of letters
    with ASCII marks behind it is the letters' ids and the marks'. The second holds for a tokenizer that lower-cases
    and cuts between letters and marks, as the one given does; a few probes tell, and words are encoded whole
    where they fail. Letters whose lower case isn't letters alone (U+0130 becomes one and a mark, which joins the marks
    behind it) are never cut. Where the ids show the ends of words, many words are encoded as one text and cut apart
    again.
    """

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        low = lambda word: word.lower() if word.isascii() else word
        self.cuts = all(ids(a + b) == ids(low(a)) + ids(b) for a in PROBES for b in (".", ",", "?!", ")...", "##", "-"))

    def learn(self, words: set[bytes]) -> None:
        known = self.words
        if len(known) > WORDS_KEPT:  # words still in use stay
            self.words = known = {w: known[w] for w in words if w in known}
        if len(self.parts) > WORDS_KEPT:
            self.parts.clear()
        parts, new, letters, others = self.parts, [], set(), set()
        for word in words.difference(known):  # looks each word up; "- known.keys()" goes through all that is known
            stem = word.rstrip(MARKS) if self.cuts else b""
            if stem.isalpha():
                stem = stem.lower()
            elif stem.isascii() or not _letters(stem.decode("utf-8")):
                if word not in parts:
                    others.add(word)
                new.append((word, word, b""))
                continue
            mark = word[len(stem):] if len(word) > len(stem) else b""
            if stem not in parts:
                letters.add(stem)
            if mark and mark not in parts:
                others.add(mark)
            new.append((word, stem, mark))
        self._encode(list(letters), True)
        self._encode(list(others), False)
        for word, stem, mark in new:
            known[word] = parts[stem] + parts[mark] if mark else parts[stem]

    def _encode(self, listed: list[bytes], together: bool) -> None:
        step = 256 if together else 1
        groups = [listed[i:i + step] for i in range(0, len(listed), step)]
        texts = [b" ".join(g).decode("utf-8") for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            raw, cut = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if together and (len(cut) != len(group) or cut[-1] != len(ids)):
                self._encode(group, False)
            elif together:
                begin = 0
                for part, end in zip(group, cut):
                    self.parts[part] = raw[4 * begin:4 * end]
                    begin = end
            else:
                self.parts[group[0]] = raw


def _pieces(spec: Broadcast, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _WORKER.get("of") != spec.value:
            _WORKER.update(of=spec.value, ids=WordIds(spec.value))
        ids: WordIds = _WORKER["ids"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                split = [t.as_py().split() for t in part.column("text").cast(pa.large_binary())]
                ids.learn(set().union(*split))
                out: list[list] = [[], [], [], [], []]
                of = ids.words.__getitem__
                for doc_id, words in zip(part.column("doc_id").to_pylist(), split):
                    raw = b"".join(map(of, words)) + b"\0\0\0\0"
                    for k, begin in enumerate(range(0, len(raw), 4 * size)):
                        piece = raw[begin:begin + 4 * size]
                        for column, value in zip(out, (doc_id, k, begin // 4, len(piece) // 4, zlib.crc32(piece))):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def _fill(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """A single length, pair or triple that fills the gap exactly, largest single first; None if there is none."""
    if have[gap]:
        return (gap,)
    at = np.flatnonzero(have[:gap])
    if len(at) == 0:
        return None
    enough = lambda parts: all(have[p] >= parts.count(p) for p in set(parts))
    for a in at[have[gap - at] > 0][::-1].tolist():
        if enough((a, gap - a)):
            return (a, gap - a)
    for a in at[::-1].tolist():
        low = at[at < gap - a]
        for b in low[have[gap - a - low] > 0][::-1].tolist():
            if enough((a, b, gap - a - b)):
                return (a, b, gap - a - b)
    return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use up the counts."""
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []
    if have[size]:
        patterns.append(((size,), int(have[size])))
        have[size] = 0
    for length in range(size - 1, 0, -1):
        while have[length]:
            have[length] -= 1
            parts = _fill(have, size - length)
            have[length] += 1
            if parts is None:
                break
            whole = (length, *parts)
            times = min(int(have[p]) // whole.count(p) for p in set(whole))
            for p in whole:
                have[p] -= times
            patterns.append((whole, times))
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(size - 1, 0, -1):
        n = int(have[length])
        while n:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                per = size // length
                full, rest = divmod(n, per)
                if full:
                    open_bins.setdefault(size - per * length, []).append(((length,) * per, full))
                if rest:
                    open_bins.setdefault(size - rest * length, []).append(((length,) * rest, 1))
                n = 0
                continue
            lengths, times = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
            used = min(n, times)
            if times > used:
                open_bins.setdefault(gap, []).append((lengths, times - used))
            open_bins.setdefault(gap - length, []).append(((*lengths, length), used))
            n -= used
    patterns += [p for group in open_bins.values() for p in group]
    return patterns


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, first sequence, offset): pieces numbered from..to-1 of a length go to consecutive sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            begin = used.get(length, 0)
            rows.append((length, begin, begin + times, sequence, offset))
            used[length] = begin + times
            offset += length
        sequence += times
    return rows


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, size: int = 2048) -> DataFrame:
    """Per piece of a row of ``docs`` (doc_id, text; other columns are not read): doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A row is its ids and id 0; a null text counts as empty, so every row has a piece. Rows longer than
    ``size`` are cut into pieces of ``size``, the last one shorter; no other row is cut. Null doc_ids and
    equal rows are packed like others. ``tokenizer_path`` is read on the driver. No rows give no rows.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    pieces_path = write_scratch(texts.mapInArrow(_pieces(spec, size), PIECES), "packing-pieces")
    pieces = spark.read.parquet(pieces_path)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(_slots(plan(counts, size)), "slot_length long, low long, high long, first long, offset long")
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    ranked_path = write_scratch(numbered(pieces, ["length"], order, F.lit(1)), "packing-ranks")
    drop_scratch(spark, pieces_path)
    ranked = spark.read.parquet(ranked_path)
    here = (F.col("length") == F.col("slot_length")) & (F.col("before") >= F.col("low")) & (F.col("before") < F.col("high"))
    # the slots' number depends on the sequence size, not on the documents
    return ranked.join(F.broadcast(slots), here).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.col("before") - F.col("low")).alias("sequence_id"), "offset")
