"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, and every distinct row of them enters the fit once. The
centred rows X are never gathered: each step sends one vector v to the tasks, which form
Xv and, from it, X'(Xv), and sends back sums of one number a dimension. Left vectors
are as long as the table, so each is kept as the combination w of dimensions it is made by
(u = Xw) beside X'u; their inner products follow from these without another pass. Left and
right vectors are both orthogonalised against all earlier ones, twice. The singular values
and right vectors of the small bidiagonal matrix give the components and their deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, write_scratch
from loghelm.llm.vectors import matrix, of_one_length

BLOCK_ROWS = 2048
LARGEST = 2.0**61
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def levels(rows: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * entry) + shift; products beyond 2^61 are held at 2^61."""
    return np.clip(np.floor(rows.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64) + shift


def _levels(length: int, kind: str, scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, good = matrix(batch.column("vec"), length, kind)
            x = [r.tobytes() for r in levels(rows[good], scale, shift)]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([blake2b(r, digest_size=16).digest() for r in x], pa.binary()), "x": pa.array(x, pa.binary())})
    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows joined to blocks, one binary value each."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield pa.RecordBatch.from_pydict({"block": pa.array([b"".join(batch.column("x").slice(at, BLOCK_ROWS).to_pylist())], pa.binary())})


class Fit:
    """The distinct rows: how many, their sums, and sums over tasks of what a function makes of a block."""

    def __init__(self, blocks: DataFrame, length: int):
        self.blocks, self.length = blocks, length
        low = (1 << 24) - 1
        parts = self._sum(lambda x: np.concatenate([[len(x)], (x >> 24).sum(axis=0), (x & low).sum(axis=0)]), "long")
        self.n = int(parts[0])
        self.sums = [(int(h) << 24) + int(k) for h, k in zip(parts[1:length + 1], parts[length + 1:])]
        self.middle = np.array([s // max(self.n, 1) for s in self.sums], np.int64)
        self.rest = [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]  # 0 <= rest < n

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        middle, shift = self.middle, np.array([r / max(self.n, 1) for r in self.rest])
        return lambda x: (x - middle).astype(np.float64) - shift

    def _sum(self, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column("block"):
                    made = of(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, length))
                    total = made if total is None else total + made
            if total is not None:
                yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(total)), pa.int32()), "value": pa.array(total)})
        made = self.blocks.mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
        rows = made.collect()  # a number a dimension, or a pair of components
        out = np.zeros(max((r["place"] for r in rows), default=2 * length) + 1, np.int64 if kind == "long" else float)
        for r in rows:
            out[r["place"]] = r["value"]
        return out

    def sum(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all blocks of ``of``, which gets a block's centred rows."""
        centred = self.centred()
        return self._sum(lambda x: of(centred(x)), "double")


def bidiagonal(
    product: Callable[[np.ndarray], np.ndarray], length: int, components: int, all_steps: int = 192, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns) of X, largest first; ``product`` gives X'(Xw).

    Runs one step a dimension up to ``all_steps`` dimensions; beyond that it ends once the wanted components
    stand still. Where the space ends early, it goes on from a random vector orthogonal to all before.
    """
    rng = np.random.default_rng(seed)
    right, made, back = (np.zeros((length, 0)) for _ in range(3))  # v, w with u = Xw, and X'u

    def clean(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - right @ (right.T @ x)
        return x

    def fresh() -> np.ndarray:
        x = clean(rng.standard_normal(length))
        return x / np.linalg.norm(x)

    alpha, beta, v, above = [], [], fresh(), 0.0
    for step in range(length):
        right = np.column_stack([right, v])
        w = v - above * made[:, -1] if step else v
        z = product(w)
        for _ in range(2):
            share = made.T @ z  # products of Xw with all earlier left vectors
            w, z = w - made @ share, z - back @ share
        size = np.sqrt(max(w @ z, 0.0))
        largest = max([size, *alpha])
        if size > 1e-13 * largest:
            w, z = w / size, z / size
        else:  # v takes part in no row: no left vector belongs to it
            size, w, z = 0.0, np.zeros(length), np.zeros(length)
        made, back = np.column_stack([made, w]), np.column_stack([back, z])
        alpha.append(size)
        if step + 1 == length:
            break
        rest = clean(z - size * v)
        above = float(np.linalg.norm(rest))
        if above > 1e-13 * largest:
            v = rest / above
        else:
            above, v = 0.0, fresh()
        if length > all_steps and step >= 2 * components and step % 8 == 0:
            left, values, _ = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
            if (above * np.abs(left[-1, :components]) < 1e-14 * values[0]).all():
                break
        beta.append(above)
    small = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1)
    _, values, turned = np.linalg.svd(small)
    return values, right @ turned.T


def _whiten(length: int, kind: str, scale: int, shift: int, fit: dict, project: np.ndarray, explained: np.ndarray, error: float):
    n, middle, rest, names = fit["n"], fit["middle"], fit["rest"], OUT.replace(",", "").split()[::2]
    off = np.array([r / n for r in rest])

    def deviations(y: np.ndarray) -> list[int | None]:
        most = int(np.abs(y).max(initial=0))
        if length * (n * (most + 1)) ** 2 < 1 << 63:
            return ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        each = (sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist())
        return [d if d < 1 << 63 else None for d in each]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            rows, good = matrix(batch.column("vec"), length, kind)
            y = levels(rows[good], scale, shift) - middle
            m = len(y)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").filter(pa.array(good)).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n)), pa.array(deviations(y), pa.int64()).take(each),
                pa.array(((y.astype(np.float64) - off) @ project).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error))], names=names)
    return run


def whiten(
    vectors: DataFrame, column: str = "embedding", components: int = 16, length: int | None = None, scale: int = 64, shift: int = 1_000_000,
) -> DataFrame:
    """Per row and component up to ``components``: vec_id, component, n, deviation, whitened, explained, identity_error.

    Reads vec_id and ``column`` of ``vectors``. Rows whose vector is null, holds null or non-finite entries, or has
    another length than ``length`` (None: the most frequent one) are left out; a null vec_id stays null and repeated
    rows each get their own. An entry c becomes floor(scale * c) + shift, held within 2^61. The fit list is each
    distinct row of these once. Components are numbered by falling eigenvalue of its covariance; those without
    variance (under 1e-13 of the whole) are not given, so equal rows throughout, or none, give no rows.
    ``deviation`` is null where it doesn't fit a long.
    """
    spark = vectors.sparkSession
    named, length, kind = of_one_length(vectors, column, length)
    if length == 0:
        return spark.createDataFrame([], OUT)
    distinct = named.mapInArrow(_levels(length, kind, scale, shift), "key binary, x binary").groupBy("key").agg(F.first("x").alias("x"))
    path = write_scratch(distinct.select("x").mapInArrow(_blocks, "block binary"), "whitening-fit")
    fit = Fit(spark.read.parquet(path), length)
    total = float(fit.sum(lambda rows: np.array([(rows**2).sum()]))[0]) if fit.n else 0.0
    if total == 0.0:
        drop_scratch(spark, path)
        return spark.createDataFrame([], OUT)

    def product(w: np.ndarray) -> np.ndarray:
        return fit.sum(lambda rows: rows.T @ (rows @ w))
    values, right = bidiagonal(product, length, components)
    kept = int((values[:components] ** 2 > 1e-13 * total).sum())
    values, right = values[:kept], right[:, :kept]
    project = right * (np.sqrt(fit.n) / values)

    def moments(rows: np.ndarray) -> np.ndarray:
        made = rows @ project
        return np.concatenate([made.sum(axis=0), (made.T @ made).ravel()])
    sums = fit.sum(moments) / fit.n
    covariance = sums[kept:].reshape(kept, kept) - np.outer(sums[:kept], sums[:kept])
    error = float(np.abs(covariance - np.eye(kept)).max())
    drop_scratch(spark, path)
    known = {"n": fit.n, "middle": fit.middle, "rest": fit.rest}
    return named.mapInArrow(_whiten(length, kind, scale, shift, known, project, values**2 / total, error), OUT)
