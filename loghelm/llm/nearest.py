"""Nearest neighbours by largest inner product, through an inverted multi-index.

Both halves of the vectors are quantised separately, each with its own centroids,
fitted on a bounded sample; a cell is a pair of centroids. A query walks the cells by
falling sum of its halves' products with the two centroids, with a heap over the two
sorted lists, until the cells hold as many entries as the index asks for, and the
entries of these cells are reranked by their exact products. How many to ask for is
measured: for a few queries all entries are scored, and the number is the one that
brings the wanted share of their true neighbours.

An entry is a distinct vector with its smallest vec_ids, as many as can be reported, so
copies are never scored twice and a vector that a third of all rows share is one
entry. Cells are joined to blocks of a few thousand entries, larger cells and hot
cells' queries are split, so every task works on a bounded block of each side. The
block of a query's first cell goes first: the least score it needs is known from there, and
the other blocks report only entries that reach it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, write_scratch
from loghelm.llm.vectors import in_order, matrix, of_one_length, unpacked

SALTS = 64
BLOCK_ENTRIES = 2048
BLOCK_QUERIES = 4096
ENTRIES_A_CELL = 50


def _rows(length: int, kind: str):
    """(vec_id, key, vec): key names the vector; zero vectors and those with null or non-finite entries are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, good = matrix(batch.column("vec"), length, kind)
            rows = rows + 0  # -0.0 becomes 0.0
            good &= (rows != 0).any(axis=1)
            vec = [r.tobytes() for r in rows[good]]
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").filter(pa.array(good)),
                "key": pa.array([blake2b(v, digest_size=16).digest() for v in vec], pa.binary()),
                "vec": pa.array(vec, pa.binary())})
    return run


def centroids(rows: np.ndarray, count: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm from ``count`` of the rows; a centroid that gets no row moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    at = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)]
    norm = (rows**2).sum(axis=1)
    for _ in range(rounds):
        far = (at**2).sum(axis=1) - 2 * rows @ at.T
        own = far.argmin(axis=1)
        n = np.bincount(own, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, own, rows)
        at = total / np.maximum(n, 1)[:, None]
        if (empty := np.flatnonzero(n == 0)).size:
            at[empty] = rows[np.argsort(-(norm + far.min(axis=1)), kind="stable")[:len(empty)]]
    return at


def nearest_centroid(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((at**2).sum(axis=1) - 2 * rows @ at.T).argmin(axis=1)


class Index:
    """Centroids of both halves, entries by cell, and blocks of cells.

    ``block`` names the block of each cell, ``parts`` into how many parts a block's entries are dealt.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, entries: np.ndarray):
        self.first, self.second, self.entries = first, second, entries
        self.half = first.shape[1]
        self.block = (np.cumsum(entries) - entries) // BLOCK_ENTRIES
        self.block = np.unique(self.block, return_inverse=True)[1]
        self.parts = np.maximum(1, -(-np.bincount(self.block, entries).astype(np.int64) // (2 * BLOCK_ENTRIES)))

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells that hold entries, by falling sum of the halves' products with their centroids."""
        a, b = self.first @ query[:self.half], self.second @ query[self.half:]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b, by_a, by_b = a[by_a].tolist(), b[by_b].tolist(), by_a.tolist(), by_b.tolist()
        filled, width = self.entries > 0, len(b)
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            cell = by_a[i] * width + by_b[j]
            if filled[cell]:
                yield cell
            if j + 1 < width:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def visited(self, query: np.ndarray, wanted: int) -> list[int]:
        """The first cells of the walk that together hold ``wanted`` entries."""
        cells, have = [], 0
        for cell in self.walk(query):
            cells.append(cell)
            have += int(self.entries[cell])
            if have >= wanted:
                break
        return cells


def _cells(first: np.ndarray, second: np.ndarray, length: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unpacked(batch.column("vec"), length, kind)
            half = first.shape[1]
            cell = nearest_centroid(rows[:, :half], first) * len(second) + nearest_centroid(rows[:, half:], second)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])
    return run


def _best(score: np.ndarray, first_id: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``most`` largest entries above -inf, ties to the smaller id, best first."""
    if score.shape[1] > most:
        least = np.partition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
        row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    else:
        row, column = np.nonzero(score > -np.inf)
    order = np.lexsort((first_id[column], -score[row, column], row))
    row, column = row[order], column[order]
    begin = np.searchsorted(row, np.arange(len(score)))
    keep = np.arange(len(row)) - begin[row] < most
    return row[keep], column[keep]


def _probe(keys: list[bytes], queries: np.ndarray, length: int, kind: str, most: int):
    """For a few queries, the best entries of a batch with their cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unpacked(batch.column("vec"), length, kind)
            first_id = batch.column("first_id").to_numpy()
            row, column = _best(queries @ rows.T, first_id, most)
            yield pa.RecordBatch.from_pydict({
                "probe": pa.array(row, pa.int32()), "score": pa.array(in_order(queries[row], rows[column])),
                "first_id": pa.array(first_id[column]), "cell": batch.column("cell").take(pa.array(column))})
    return run


def _plan(index: Index, wanted: int, length: int, kind: str):
    """(key, vec, block, cells, leads): a row for each block a query visits, with its cells there; its first cell's leads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unpacked(batch.column("vec"), length, kind)
            at, blocks, cells, leads = [], [], [], []
            for i, query in enumerate(rows):
                walked = index.visited(query, wanted)
                seen = np.sort(np.array(walked, np.int32))
                of = index.block[seen]
                cut = np.flatnonzero(np.diff(of, prepend=-1))
                blocks += of[cut].tolist()
                leads += (of[cut] == index.block[walked[0]]).tolist() if walked else []
                cells += np.split(seen, cut[1:]) if len(cut) else []
                at += [i] * len(cut)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key").take(pa.array(at, pa.int32())), "vec": batch.column("vec").take(pa.array(at, pa.int32())),
                "block": pa.array(blocks, pa.int32()), "cells": pa.array([c.tolist() for c in cells], pa.list_(pa.int32())), "leads": pa.array(leads, pa.bool_())})
    return run


def _rerank(length: int, kind: str, most: int):
    """The best entries among a block's for the queries that visit it, from the least score a query needs on.

    Cells a query doesn't visit don't count.
    """
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        rows = unpacked(entries.column("vec"), length, kind) if len(entries) else np.zeros((0, length))
        cells, of = np.unique(entries.column("cell").to_numpy(), return_inverse=True)
        ids = entries.column("ids").combine_chunks()
        first_id = entries.column("first_id").to_numpy()
        for at in range(0, len(queries) if len(entries) else 0, 256):
            part = queries.slice(at, 256)
            asked = unpacked(part.column("vec"), length, kind)
            listed = part.column("cells").combine_chunks()
            seen = listed.flatten().to_numpy()
            who = np.repeat(np.arange(len(part)), np.diff(listed.offsets.to_numpy()))
            place = np.minimum(np.searchsorted(cells, seen), len(cells) - 1)
            here = cells[place] == seen
            visits = np.zeros((len(part), len(cells)), bool)
            visits[who[here], place[here]] = True
            row, column = _best(np.where(visits[:, of], asked @ rows.T, -np.inf), first_id, most)
            score = in_order(asked[row], rows[column])
            enough = score >= part.column("least").to_numpy()[row]
            row, column, score = row[enough], column[enough], score[enough]
            out.append(pa.table({
                "key": part.column("key").take(pa.array(row)), "score": pa.array(score), "ids": ids.take(pa.array(column))}))
        return pa.concat_tables(out) if out else pa.table({
            "key": pa.array([], pa.binary()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
    return run


def _entries(rows: DataFrame, most: int) -> DataFrame:
    """(key, first_id, ids, vec): each distinct vector with its ``most`` smallest ids.

    Ids are cut down per part of a key first, so a vector that many rows share is spread over tasks.
    """
    named = rows.select("key", "vec_id").distinct().withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for parts in (["key", "_salt"], ["key"]):
        named = named.withColumn("_n", F.row_number().over(W.partitionBy(*parts).orderBy("vec_id"))).where(F.col("_n") <= most).drop("_n")
    ids = named.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("first_id", F.col("ids")[0])
    one = rows.groupBy("key", F.col("vec_id").alias("first_id")).agg(F.first("vec").alias("vec"))
    return one.join(ids.hint("merge"), ["key", "first_id"]).select("key", "first_id", "ids", "vec")


def nearest_neighbours(
    vectors: DataFrame, column: str = "embedding", every: int = 20, neighbours: int = 20, length: int | None = None,
    sample_rows: int = 20_000, most_centroids: int = 512, least_entries: int = 4_096, recall: float = 0.97, probes: int = 96,
) -> DataFrame:
    """Per query, its ``neighbours`` nearest rows: query_id, rank, vec_id, score; queries have a vec_id divisible by ``every``.

    Reads vec_id and ``column`` of ``vectors``. Nearness is the largest inner product, in double precision; ties go to
    the smaller vec_id, a query's own vec_id is no candidate, and fewer candidates give fewer rows. Rows whose
    vec_id or vector is null, whose vector is zero, holds null or non-finite entries, or has another length than
    ``length`` (None: the most frequent one) take no part. Rows equal in both count once; a vec_id on several vectors
    asks once for each. No rows, or no row but the query, give none.

    Centroids of a half, sqrt of one for every 50 entries and ``most_centroids`` at most, are fitted on
    ``sample_rows`` distinct vectors, the first by a hash; every distinct vector is indexed. The ``probes`` queries first by
    a hash are compared with all entries, and each query lists as many entries as bring the share ``recall`` of the probes' true
    neighbours, ``least_entries`` at least. To the driver go the sample, the probes' neighbours, and counts by cell and block.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    named, length, kind = of_one_length(vectors.where("vec_id IS NOT NULL"), column, length)
    if length == 0:
        return nothing
    most = neighbours + 1  # one of them may be the query
    rows = named.mapInArrow(_rows(length, kind), "vec_id long, key binary, vec binary")
    entries_path = write_scratch(_entries(rows, most), "nearest-entries")
    entries = spark.read.parquet(entries_path)
    total = entries.count()
    if total == 0:
        drop_scratch(spark, entries_path)
        return nothing
    some = entries.where(F.pmod(F.xxhash64("key"), F.lit(total)) < 2 * sample_rows).orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    sample = np.concatenate([np.frombuffer(r["vec"], kind) for r in some.select("vec").collect()]).reshape(-1, length).astype(float)
    count, half = int(np.clip(round((total / ENTRIES_A_CELL) ** 0.5), 1, most_centroids)), length // 2
    first, second = centroids(sample[:, :half], count), centroids(sample[:, half:], count, seed=2)
    celled_path = write_scratch(entries.mapInArrow(
        _cells(first, second, length, kind), "key binary, first_id long, ids array<long>, vec binary, cell int"), "nearest-cells")
    drop_scratch(spark, entries_path)
    celled = spark.read.parquet(celled_path)
    held = np.zeros(len(first) * len(second), np.int64)
    for r in celled.groupBy("cell").count().collect():  # one row for a pair of centroids at most
        held[r["cell"]] = r["count"]
    index = Index(first, second, held)

    asking = rows.where(F.col("vec_id") % every == 0)
    # a walk costs far more than reading its query: as many tasks as there are shuffle partitions
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked_path = write_scratch(asking.groupBy("key").agg(F.first("vec").alias("vec")).repartition(tasks), "nearest-queries")
    asked = spark.read.parquet(asked_path)
    n_asked = max(asked.count(), 1)
    probing = asked.where(F.pmod(F.xxhash64("key"), F.lit(n_asked)) < 4 * probes).orderBy(F.xxhash64("key"), "key").limit(probes).collect()
    wanted = _entries_wanted(celled, index, probing, length, kind, most, recall, least_entries)

    plan_path = write_scratch(asked.mapInArrow(
        _plan(index, wanted, length, kind), "key binary, vec binary, block int, cells array<int>, leads boolean"), "nearest-plan")
    drop_scratch(spark, asked_path)
    plan = spark.read.parquet(plan_path)
    search = lambda part, label: write_scratch(_search(celled, part, index, length, kind, most), label)
    led_path = search(plan.where("leads").withColumn("least", F.lit(float("-inf"))), "nearest-led")
    led = spark.read.parquet(led_path)
    needs = led.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= most).drop("n")
    rest = plan.where("NOT leads").join(needs.hint("merge"), "key", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest_path = search(rest, "nearest-rest")
    drop_scratch(spark, celled_path, plan_path)
    by_score = W.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0])
    listed = led.union(spark.read.parquet(rest_path)).withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= most)
    near = listed.select("key", "score", F.explode("ids").alias("vec_id")).groupBy("key").agg(F.slice(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, most).alias("near"))
    own = asking.select(F.col("vec_id").alias("query_id"), "key").distinct()
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, neighbours)
    return own.join(near.hint("merge"), "key").select("query_id", F.posexplode(others).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", (-F.col("one.minus")).alias("score"))


def _search(celled: DataFrame, plan: DataFrame, index: Index, length: int, kind: str, most: int) -> DataFrame:
    """(key, score, ids): the best entries of each block that ``plan`` names, for its query."""
    spark = celled.sparkSession
    visits = {r["block"]: r["count"] for r in plan.groupBy("block").count().collect()}  # no more blocks than cells
    split = np.array([-(-visits.get(b, 0) // BLOCK_QUERIES) for b in range(len(index.parts))])
    cells_of = spark.createDataFrame(
        [(int(c), int(index.block[c]), int(index.parts[index.block[c]]), int(split[index.block[c]])) for c in np.flatnonzero(index.entries)],
        "cell int, block int, parts int, split int").where("split > 0")
    parts_of = spark.createDataFrame(
        [(b, int(index.parts[b]), int(split[b])) for b in visits] or [(-1, 1, 1)], "block int, parts int, split int")
    dealt = lambda seed, into: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(into)).cast("int")
    each = lambda into: F.explode(F.sequence(F.lit(0), F.col(into) - 1))
    left = celled.join(F.broadcast(cells_of), "cell").select(  # a row for a pair of centroids at most
        "first_id", "ids", "vec", "cell", "block", dealt(1, "parts").alias("part"), each("split").alias("share"))
    right = plan.join(F.broadcast(parts_of), "block").select(  # no more blocks than cells
        "key", "vec", "cells", "least", "block", each("parts").alias("part"), dealt(2, "split").alias("share"))
    group = ["block", "part", "share"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        _rerank(length, kind, most), "key binary, score double, ids array<long>")


def _entries_wanted(
    celled: DataFrame, index: Index, probing: list, length: int, kind: str, most: int, recall: float, least: int,
) -> int:
    """How many entries a query has to list for the share ``recall`` of the probes' true neighbours."""
    keys = [bytes(r["key"]) for r in probing]
    queries = np.frombuffer(b"".join(bytes(r["vec"]) for r in probing), kind).reshape(-1, length).astype(float)
    if len(keys) == 0 or index.entries.sum() <= least:
        return least
    scored = celled.mapInArrow(_probe(keys, queries, length, kind, most), "probe int, score double, first_id long, cell int")
    by_score = W.partitionBy("probe").orderBy(F.desc("score"), "first_id")
    true = scored.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= most).select("probe", "cell").collect()
    needs: list[int] = []
    for i, query in enumerate(queries):
        walked = np.fromiter(index.walk(query), np.int64)
        listed = np.zeros(len(index.entries), np.int64)
        listed[walked] = np.cumsum(index.entries[walked])
        needs += [int(listed[r["cell"]]) for r in true if r["probe"] == i]
    return max(least, int(np.quantile(needs, recall, method="higher")))
