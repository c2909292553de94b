"""Near copies by SimHash fingerprints, found over the anchors of a covering code.

Anchors are the code words of a product of perfect codes: the binary Golay code
on bits 0-22 and 23-45 of the fingerprint (covering radius 3 each) and, for very
many fingerprints, the Hamming code on bits 46-60 (radius 1). Every fingerprint
has one nearest anchor, its home, and is replicated to every anchor within the
covering radius plus the threshold, block by block, the blocks sharing the
threshold. Two fingerprints within the threshold meet at either one's home, so
per anchor homes are compared with visitors. Links of an anchor leave it as a
forest, not as pairs; connected components are joined over all anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, matching, text_keys, write_scratch

MAX_PAIRS = 1 << 21
ENTRIES = "bucket int, anchor binary, fp binary, home binary"


def fingerprint(words: list[bytes]) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all runs of three words, of all words if fewer; 0 for none."""
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < 3:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[:-2].tolist()
    n, ones = len(begins), np.zeros(64, np.int64)
    ends = ends[2:].tolist()
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(begins[at:at + (1 << 16)], ends[at:at + (1 << 16)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(t.as_py().lower().split()) for t in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "crc", "hash")), pa.array(np.array(fps, np.uint64).view(np.int64))],
            names=["doc_id", "crc", "hash", "fp"])


class Block:
    """A perfect code on some bits: for each syndrome, the error patterns by distance beyond the covering radius."""

    def __init__(self, low: int, n: int, poly: int, radius: int, extra: int):
        self.low, self.n, self.checks = low, n, poly.bit_length() - 1
        self.unit = np.array([self._mod(1 << i, poly) for i in range(n)], np.int64)
        self.patterns: list[list[list[int]]] = [[[] for _ in range(1 << self.checks)] for _ in range(extra + 1)]
        for weight in range(radius + extra + 1):
            for bits in combinations(range(n), weight):
                syndrome = 0
                for i in bits:
                    syndrome ^= int(self.unit[i])
                self.patterns[max(0, weight - radius)][syndrome].append(sum(1 << i for i in bits))
        self.flat, self.begin = [], []
        for by in self.patterns:
            self.begin.append(np.cumsum([0, *map(len, by)]))
            self.flat.append(np.array([p for x in by for p in x], np.uint64))

    @staticmethod
    def _mod(value: int, poly: int) -> int:
        while value.bit_length() >= poly.bit_length():
            value ^= poly << (value.bit_length() - poly.bit_length())
        return value

    def value(self, fp: np.ndarray) -> np.ndarray:
        return (fp >> np.uint64(self.low)) & np.uint64((1 << self.n) - 1)

    def syndrome(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(value), np.int64)
        for i in range(self.n):
            out ^= np.where((value >> np.uint64(i)) & np.uint64(1), self.unit[i], 0)
        return out

    def near(self, value: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, code word) for all code words ``beyond`` the radius, exactly; 0 means within it."""
        s = self.syndrome(value)
        begin = self.begin[beyond]
        many = begin[s + 1] - begin[s]
        row = np.repeat(np.arange(len(value)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + begin[s][row]
        return row, value[row] ^ self.flat[beyond][place]


@lru_cache
def blocks(n_blocks: int, threshold: int) -> tuple[Block, ...]:
    # Generator polynomials of the Golay (23, 12) and the Hamming (15, 11) code.
    kinds = [(0, 23, 0b110001110101, 3), (23, 23, 0b110001110101, 3), (46, 15, 0b10011, 1)]
    return tuple(Block(*kind, threshold) for kind in kinds[:n_blocks])


def anchors(fp: np.ndarray, n_blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for all anchors a fingerprint is replicated to."""
    rows, names, homes = [np.arange(len(fp))], [np.zeros(len(fp), np.uint64)], [np.zeros(len(fp), np.int64)]
    row, name, spent = rows[0], names[0], homes[0]
    for block in blocks(n_blocks, threshold):
        value = block.value(fp)
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for beyond in range(threshold + 1):
            of, word = block.near(value, beyond)
            begin = np.searchsorted(of, np.arange(len(fp) + 1))
            may = np.flatnonzero(spent + beyond <= threshold)
            many = (begin[1:] - begin[:-1])[row[may]]
            take = np.repeat(may, many)
            place = np.arange(len(take)) - np.repeat(np.cumsum(many) - many, many) + begin[row[take]]
            new.append((row[take], (name[take] << np.uint64(block.n)) | word[place], spent[take] + beyond))
        row, name, spent = (np.concatenate(x) for x in zip(*new))
    return row, name, spent == 0


def _replicate(n_blocks: int, threshold: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                fp = batch.column("fp").slice(at, 1 << 14).to_numpy(zero_copy_only=False).view(np.uint64)
                row, name, home = anchors(fp, n_blocks, threshold)
                bucket = ((name * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                begin = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = [(b, order[i:j]) for b, (i, j) in enumerate(zip(begin[:-1], begin[1:])) if j > i]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in out], pa.int32()), pa.array([name[w].tobytes() for _, w in out], pa.binary()),
                    pa.array([fp[row[w]].tobytes() for _, w in out], pa.binary()),
                    pa.array([home[w].tobytes() for _, w in out], pa.binary())], names=["bucket", "anchor", "fp", "home"])
    return run


class Forest:
    """Components of the points 0 to n - 1, joined bit by bit."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.root[u], self.root[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _linked(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in group.column(name)), kind)
        anchor, fp, home = whole("anchor", np.uint64), whole("fp", np.uint64), whole("home", bool)
        order = np.lexsort((fp, anchor))
        anchor, fp, home = anchor[order], fp[order], home[order]
        points, point = np.unique(fp, return_inverse=True)
        forest = Forest(len(points))
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        sizes = np.diff(np.append(begin, len(anchor)))
        of = np.repeat(np.arange(len(begin)), sizes)
        hosts = np.flatnonzero(home & (sizes[of] > 1))
        dense = sizes[of[hosts]] > 100_000  # there each host's neighbours are looked up
        many = sizes[of[hosts[~dense]]]
        ends = np.cumsum(many)
        at = 0
        while at < len(many):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MAX_PAIRS, "right")))
            host, n = hosts[~dense][at:to], many[at:to]
            left = np.repeat(host, n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[of[host]], n)
            close = np.bitwise_count(fp[left] ^ fp[right]) <= threshold
            forest.join(point[left[close]], point[right[close]])
            at = to
        flips = [np.uint64(sum(1 << i for i in bits)) for w in range(1, threshold + 1) for bits in combinations(range(64), w)]
        host = hosts[dense]
        for flip in flips if len(host) else ():
            other = fp[host] ^ flip
            place = np.minimum(np.searchsorted(points, other), len(points) - 1)
            met = points[place] == other
            forest.join(point[host[met]], place[met])
        member = np.flatnonzero(forest.root != np.arange(len(points)))
        return pa.table({"u": points[member].view(np.int64), "v": points[forest.root[member]].view(np.int64)})
    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of (u, v); root is the least node reachable.

    Every round hooks each node's neighbours to the least node it knows (large star), then each node and
    its lesser neighbours to the least of them (small star), until nothing changes; each round is written.
    """
    spark = links.sparkSession
    path = write_scratch(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        edges = spark.read.parquet(path)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = state
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = write_scratch(small.where("u != v").distinct(), "links")
        del edges, both, least, large, low, small
        drop_scratch(spark, path)
        path = after


def _grouped(docs: DataFrame, threshold: int) -> DataFrame:
    """doc_id, crc and hash of the text, fp, the root fingerprint of its component, component_id, n_same."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *text_keys())
    rows_path = write_scratch(texts.mapInArrow(_fingerprints, "doc_id long, crc long, hash long, fp long"), "simhash-rows")
    rows = spark.read.parquet(rows_path)
    prints_path = write_scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_same")), "simhash-prints")
    prints = spark.read.parquet(prints_path)
    n = prints.count()
    n_blocks = 2 if n < 1 << 28 else 3
    buckets = max(16, -(-n // 4_096))
    entries = prints.select("fp").mapInArrow(_replicate(n_blocks, threshold, buckets), ENTRIES)
    found = components(entries.groupBy("bucket").applyInArrow(_linked(threshold), "u long, v long"))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first", "n_same", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = write_scratch(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "n_same", "root", "component_id"), "simhash-named")
    drop_scratch(spark, prints_path)
    return rows.join(spark.read.parquet(named), F.col("fp") == F.col("_fp")).drop("_fp")


def near_copies(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, fingerprint, component_id, n_same.

    Fingerprints of at most ``threshold`` differing bits are linked; component_id is the least doc_id
    reachable, n_same the number of rows of the same fingerprint. Null and empty texts have fingerprint
    zero and link like others. A null doc_id never is a component_id unless all of its component are null.
    No rows give no rows.
    """
    return _grouped(docs, threshold).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")


def keep_one_near(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """One row of each component, all columns as they are: the least doc_id (null last), then the least crc and hash."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc", "hash")
    stay = _grouped(docs, threshold).groupBy("root").agg(F.min(first).alias("first")).select("first.doc_id", "first.crc", "first.hash")
    return matching(docs, stay, once=True)
