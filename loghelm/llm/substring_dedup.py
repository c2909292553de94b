"""Removal of word passages that repeat across documents, by level-wise doubling.

The shortest level has windows of ``width`` words. Texts are packed into chunks
of a few megabytes; a chunk names each window once, however often it holds it,
so a passage that a third of all documents share costs one entry a chunk.

1. Screen: chunks send 32 bits of each window's code to the bucket of its
   leading bits; the bucket answers, a bit an entry, which ones another chunk
   has too. Buckets hold about the same number of windows at any size, so the
   share of false answers stays the same.
2. Exact level: of windows that passed, chunks send 96 more bits and the
   smallest doc_id; the answer says who has them too and who has them earlier.
3. Doubling: windows repeated at one length, and they alone, are joined with
   the repeated window that follows them to windows of twice the length, named
   by the pair of names. Rounds go on until no candidate survives.

Answers go back to chunks by a join on the chunk; no window is ever paired with
another. Windows are compared by 128-bit codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, write_scratch
from loghelm.llm.words import Texts, mix, windows

CHUNK_BYTES = 4 << 20
WINDOWS_PER_BUCKET = 1 << 19
LAST = np.iinfo(np.int64).max

CHUNKS = "chunk long, n_words long, blob binary"
ENTRIES = "bucket int, chunk long, rem binary, rem2 binary, first binary"
ANSWERS = "chunk long, bucket int, shared binary, earlier binary"
RESULTS = "chunk long, doc_no int, doc_id long, n_words long, n_removed long, kept_sha256 string, n_left long, state binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def chunk() -> pa.RecordBatch:
        nonlocal number, ids, texts, size
        blob = zstandard.compress(
            np.array([len(ids)], np.int64).tobytes() + np.array(ids, np.int64).tobytes()
            + np.fromiter(map(len, texts), np.int64, len(texts)).tobytes() + b"".join(texts), 3)
        words = sum(Texts(texts[i:i + 1000]).first[-1] for i in range(0, len(texts), 1000))
        row = pa.RecordBatch.from_pydict({
            "chunk": [(task << 32) + number], "n_words": [int(words)], "blob": pa.array([blob], pa.binary())})
        number, ids, texts, size = number + 1, [], [], 0
        return row

    for batch in batches:
        texts_in = batch.column("text").cast(pa.large_binary())
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_in):
            text = text.as_py()
            ids.append(LAST if doc_id is None else doc_id)
            texts.append(text)
            size += len(text) + 16
            if size >= CHUNK_BYTES:
                yield chunk()
    if ids:
        yield chunk()


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    ends = 8 + 16 * n + np.cumsum(sizes)
    return ids, [raw[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]


class Chunk:
    """The windows of one chunk and the screen keys that stand for them."""

    def __init__(self, blob: bytes, width: int, bits: int):
        self.ids, self.raw = _unpack(blob)
        self.texts = Texts(self.raw)
        self.at, self.hi = windows(self.texts.codes(0), self.texts.doc, width)
        self.lo = windows(self.texts.codes(1), self.texts.doc, width)[1]
        self.doc = self.texts.doc[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.key = self.hi >> np.uint64(32 - bits)
        self.keys, self.of_key = np.unique(self.key, return_inverse=True)


class Candidates:
    """Windows that passed the screen, grouped by their whole code; ``bits`` cut them into buckets."""

    def __init__(self, c: Chunk, bits: int, answers: list):
        passed = _flags(c.keys, bits + 32, bits, answers, "shared")
        often = np.bincount(c.of_key, minlength=len(c.keys)) > 1
        self.which = np.flatnonzero((passed | often)[c.of_key])
        hi, lo, doc = c.hi[self.which], c.lo[self.which], c.doc[self.which]
        order = np.lexsort((lo, hi))
        new = np.ones(len(order), bool)
        new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
        begin = np.flatnonzero(new)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.hi, self.lo = hi[order][begin], lo[order][begin]
        owner = c.ids[doc]
        cut = lambda values, how: how.reduceat(values[order], begin) if len(begin) else np.zeros(0, np.int64)
        self.first = cut(owner, np.minimum)
        self.local = cut(doc, np.minimum) != cut(doc, np.maximum)
        self.sent = passed[c.of_key[self.which]][order][begin] if len(begin) else np.zeros(0, bool)


def _by_bucket(keys: np.ndarray, key_bits: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    bucket = (keys >> np.uint64(key_bits - bits)).astype(np.int64)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)]))


def _flags(keys: np.ndarray, key_bits: int, bits: int, answers: list, which: str) -> np.ndarray:
    """The answers' bits, laid beside the sorted keys that were sent."""
    out = np.zeros(len(keys), bool)
    said = {a["bucket"]: a[which] for a in answers or ()}
    for bucket, a, b in _by_bucket(keys, key_bits, bits):
        if said.get(bucket) is not None:
            out[a:b] = np.unpackbits(np.frombuffer(said[bucket], np.uint8), count=b - a).astype(bool)
    return out


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, schema.split(", "))], names=names)


def _screen(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = Chunk(row["blob"], width, bits).keys
                yield _rows(ENTRIES, [
                    (b, row["chunk"], keys[i:j].astype(np.uint32).tobytes(), None, None)
                    for b, i, j in _by_bucket(keys, bits + 32, bits)])
    return run


def _exact(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = Candidates(Chunk(row["blob"], width, bits), bits, row["screened"])
                hi, lo, first = found.hi[found.sent], found.lo[found.sent], found.first[found.sent]
                narrow = np.uint32 if len(first) and 0 <= first.min() and first.max() < 2**32 else np.int64
                yield _rows(ENTRIES, [
                    (b, row["chunk"], lo[i:j].tobytes(), hi[i:j].astype(np.uint32).tobytes(), first[i:j].astype(narrow).tobytes())
                    for b, i, j in _by_bucket(hi, 64, bits)])
    return run


def _answer(key: tuple, group: pa.Table) -> pa.Table:
    """Of a bucket's entries: which ones another chunk sent too, and which of them with a smaller first doc_id."""
    bucket, chunks = key[0].as_py(), group.column("chunk").to_pylist()
    rem = group.column("rem").to_pylist()
    rem2, first = group.column("rem2").to_pylist(), group.column("first").to_pylist()
    codes = [np.frombuffer(x, np.uint32 if group.column("wide")[0].as_py() == 4 else np.uint64) for x in rem]
    sizes = np.array([len(x) for x in codes])
    code = np.concatenate(codes)
    if rem2[0] is not None:
        second = np.concatenate([np.frombuffer(x, np.uint32) for x in rem2])
        docs = np.concatenate([np.frombuffer(x, np.uint32 if len(x) == 4 * n else np.int64).astype(np.int64) for x, n in zip(first, sizes)])
        order = np.lexsort((second, code))
        same = (code[order][1:] == code[order][:-1]) & (second[order][1:] == second[order][:-1])
    else:
        docs = None
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
    shared = np.zeros(len(code), bool)
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    earlier = None
    if docs is not None:
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(docs[order], begin)
        earlier = np.empty(len(code), bool)
        earlier[order] = docs[order] > np.repeat(least, np.diff(np.append(begin, len(code))))
    ends = np.cumsum(sizes)
    rows = [
        (c, bucket, np.packbits(shared[e - n:e]).tobytes(), None if earlier is None else np.packbits(earlier[e - n:e]).tobytes())
        for c, n, e in zip(chunks, sizes.tolist(), ends.tolist()) if shared[e - n:e].any()]
    return pa.Table.from_batches([_rows(ANSWERS, rows)])


def _with(chunks: DataFrame, path: str, name: str) -> DataFrame:
    """Chunks beside what they were told. Answers grow with the corpus, so they are never broadcast."""
    answers = chunks.sparkSession.read.parquet(path).withColumnRenamed("said", name)
    return chunks.join(answers.hint("merge"), "chunk", "left")


def _asked(entries: DataFrame, wide: int) -> str:
    """Answers of all buckets, written; one row a chunk holds what it was told."""
    answers = entries.withColumn("wide", F.lit(wide)).groupBy("bucket").applyInArrow(_answer, ANSWERS)
    return write_scratch(
        answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "shared", "earlier")).alias("said")), "substring-answers")


def _apply(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _rows(RESULTS, list(_judged(row, width, bits)))
    return run


def _judged(row: dict, width: int, bits: int) -> Iterator[tuple]:
    c = Chunk(row["blob"], width, bits)
    found = Candidates(c, bits, row["screened"])
    shared, earlier = np.zeros(len(found.hi), bool), np.zeros(len(found.hi), bool)
    shared[found.sent] = _flags(found.hi[found.sent], 64, bits, row["told"], "shared")
    earlier[found.sent] = _flags(found.hi[found.sent], 64, bits, row["told"], "earlier")
    t, n = c.texts, len(c.texts.starts)
    out = earlier[found.group] | (c.ids[c.doc[found.which]] > found.first[found.group])
    step = np.zeros(n + 1, np.int32)
    begun = c.at[found.which[out]]
    np.add.at(step, begun, 1)
    np.add.at(step, begun + width, -1)
    kept = np.cumsum(step[:n]) == 0
    for d, raw in enumerate(c.raw):
        a, b = t.first[d], t.first[d + 1]
        words, keep = raw.split(), kept[a:b]
        if not keep.all():
            words = list(compress(words, keep.tolist()))
        doc_id = int(c.ids[d])
        yield (row["chunk"], d, None if doc_id == LAST else doc_id, int(b - a), int(b - a) - len(words),
               hashlib.sha256(b" ".join(words)).hexdigest(), None, None)
    again = (shared | found.local)[found.group]
    at = c.at[found.which[again]]
    reached = np.zeros(len(c.ids), np.int32)
    reached[np.unique(t.doc[at])] = width
    yield (row["chunk"], -1, None, None, None, None, len(at),
           _state(at, t.doc[at], found.hi[found.group[again]] ^ mix(found.lo[found.group[again]]), reached))


def _state(at: np.ndarray, doc: np.ndarray, name: np.ndarray, reached: np.ndarray) -> bytes:
    return zstandard.compress(
        np.array([len(at), len(reached)], np.int64).tobytes() + np.diff(at, prepend=0).astype(np.int32).tobytes()
        + np.diff(doc, prepend=0).astype(np.int32).tobytes() + name.tobytes() + reached.tobytes(), 1)


class Doubled:
    """Windows of twice the length, made of two repeated windows side by side."""

    def __init__(self, state: bytes, length: int):
        raw = zstandard.decompress(state)
        n, docs = np.frombuffer(raw, np.int64, 2).tolist()
        at = np.cumsum(np.frombuffer(raw, np.int32, n, 16), dtype=np.int64)
        doc = np.cumsum(np.frombuffer(raw, np.int32, n, 16 + 4 * n), dtype=np.int64)
        name = np.frombuffer(raw, np.uint64, n, 16 + 8 * n)
        self.reached = np.frombuffer(raw, np.int32, docs, 16 + 16 * n).copy()
        nxt = np.searchsorted(at, at + length)
        nxt[nxt == n] = 0
        both = np.flatnonzero((at[nxt] == at + length) & (doc[nxt] == doc)) if n else np.zeros(0, np.int64)
        self.at, self.doc = at[both], doc[both]
        self.name = mix(name[both] * np.uint64(0xD6E8FEB86659FD93) + mix(name[nxt[both]] + np.uint64(length)))
        self.names, self.group = np.unique(self.name, return_inverse=True)
        order = np.argsort(self.group, kind="stable")
        begin = np.searchsorted(self.group[order], np.arange(len(self.names)))
        cut = lambda how: how.reduceat(self.doc[order], begin) if len(begin) else np.zeros(0, np.int64)
        self.local = cut(np.minimum) != cut(np.maximum)


def _double(length: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = Doubled(row["state"], length).names
                yield _rows(ENTRIES, [
                    (b, row["chunk"], names[i:j].tobytes(), None, None) for b, i, j in _by_bucket(names, 64, bits)])
    return run


def _survive(length: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = Doubled(row["state"], length)
                stay = (_flags(d.names, 64, bits, row["told"], "shared") | d.local)[d.group]
                at, doc = d.at[stay], d.doc[stay]
                d.reached[np.unique(doc)] = 2 * length
                yield _rows("chunk long, n_left long, state binary", [
                    (row["chunk"], len(at), _state(at, doc, d.name[stay], d.reached))])
    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = zstandard.decompress(row["state"])
            n, docs = np.frombuffer(raw, np.int64, 2).tolist()
            reached = np.frombuffer(raw, np.int32, docs, 16 + 16 * n)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([row["chunk"]] * docs, pa.int64()), "doc_no": pa.array(np.arange(docs, dtype=np.int32)),
                "longest_repeat": pa.array(reached.astype(np.int64))})


def _bits(total: int) -> int:
    return max(4, int(np.ceil(np.log2(max(1, total / WINDOWS_PER_BUCKET)))))


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, n_words, n_removed,
    kept_sha256, longest_repeat.

    A word goes if a window of ``width`` words over it also starts in a row of smaller doc_id; all windows
    are judged on the input. ``longest_repeat`` is the longest level (``width`` doubled some times, or 0) at
    which a window of the row occurs in another row too. A null text has no words; a null doc_id counts as
    larger than all others; rows of equal doc_id don't remove from each other. No rows give no rows.
    """
    spark = docs.sparkSession
    chunk_path = write_scratch(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pack, CHUNKS), "substring-chunks")
    chunks = spark.read.parquet(chunk_path)
    bits = _bits(chunks.agg(F.sum("n_words")).first()[0] or 0)

    screen_path = _asked(chunks.mapInArrow(_screen(width, bits), ENTRIES), 4)
    screened = _with(chunks, screen_path, "screened")
    drop_scratch(spark)
    exact_path = _asked(screened.mapInArrow(_exact(width, bits), ENTRIES), 8)
    told = _with(screened, exact_path, "told")
    drop_scratch(spark)
    result_path = write_scratch(told.mapInArrow(_apply(width, bits), RESULTS), "substring-results")
    del screened, told, chunks
    drop_scratch(spark, chunk_path, screen_path, exact_path)

    results = spark.read.parquet(result_path)
    state, state_path, length = results.where("doc_no = -1").select("chunk", "n_left", "state"), None, width
    left = state.agg(F.sum("n_left")).first()[0] or 0
    while left:
        bits = _bits(left)
        answer_path = _asked(state.mapInArrow(_double(length, bits), ENTRIES), 8)
        told = _with(state, answer_path, "told")
        next_path = write_scratch(
            told.mapInArrow(_survive(length, bits), "chunk long, n_left long, state binary"), "substring-state")
        del told, state
        drop_scratch(spark, *filter(None, [answer_path, state_path]))
        state, state_path, length = spark.read.parquet(next_path), next_path, 2 * length
        left = state.agg(F.sum("n_left")).first()[0]
    levels = state.mapInArrow(_levels, "chunk long, doc_no int, longest_repeat long")
    kept = results.where("doc_no >= 0").select("chunk", "doc_no", "doc_id", "n_words", "n_removed", "kept_sha256")
    # one row a document: never broadcast
    return kept.join(levels.hint("merge"), ["chunk", "doc_no"], "left").select(
        "doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("longest_repeat", F.lit(0)).alias("longest_repeat"))
