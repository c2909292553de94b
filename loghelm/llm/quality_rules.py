"""Quality rules, with an isolation forest on their statistics.

Rule statistics are counted over every whole text. Trees split a random
statistic at a random point of the node's box, which starts as the range over all
documents; documents that lie where few good ones do end on short paths. The
forest is fitted on a bounded sample of labelled good rows, the threshold on the
path lengths of all labelled rows. Documents are scored from the statistics;
texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, one_label, write_scratch
from loghelm.llm.text_stats import stats
from loghelm.llm.words import Texts

RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "dup_lines", "repeats", "length", "upper", "digits", "marks", "different", "top", "ended", "per_line"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in RULES) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def features(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    words = np.maximum(s["n_words"], 1).astype(float)
    chars = np.maximum(s["word_chars"], 1).astype(float)
    lines = np.maximum(s["n_lines"], 1).astype(float)
    return {
        "symbols": np.log1p(s["n_symbols"] / words), "dup_lines": s["n_dup_lines"] / lines, "repeats": s["n_repeat_words"] / words,
        "length": np.log(chars / words), "upper": s["n_upper"] / chars, "digits": s["n_digits"] / chars,
        "marks": np.log1p(s["n_marks"] / words), "different": np.log1p(s["n_different"]) / np.log1p(words),
        "top": s["n_top"] / words, "ended": s["n_ended"] / words, "per_line": np.log1p(words / lines)}


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            raw = part.column("text").cast(pa.large_binary()).to_pylist()
            s = stats(Texts(raw), raw)
            out = {"doc_id": part.column("doc_id")} | {c: pa.array(s[c].astype(np.int64)) for c in RULES}
            yield pa.RecordBatch.from_pydict(out | {c: pa.array(v) for c, v in features(s).items()})


class Forest:
    """Isolation trees whose splits are uniform in the node's box, not in the span of its rows."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, sample: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            take = rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)]
            nodes: list[list[float]] = []
            self._grow(take, low.copy(), high.copy(), 0, depth, rng, nodes)
            self.trees.append(np.array(nodes).T)

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, at: int, depth: int, rng: np.random.Generator, nodes: list) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, at + _mean_path(len(rows))])
        open_ = np.flatnonzero(high > low)
        if len(rows) > 1 and at < depth and len(open_):
            f = int(rng.choice(open_))
            cut = float(rng.uniform(low[f], high[f]))
            left_high, right_low = high.copy(), low.copy()
            left_high[f] = right_low[f] = cut
            below = rows[:, f] < cut
            left = self._grow(rows[below], low, left_high, at + 1, depth, rng, nodes)
            right = self._grow(rows[~below], right_low, high, at + 1, depth, rng, nodes)
            nodes[me] = [f, cut, left, right, 0.0]
        return me

    def path(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, length in self.trees:
            node = np.zeros(len(rows), np.int64)
            going = every
            while len(going):
                f = feature[node[going]].astype(np.int64)
                going, f = going[f >= 0], f[f >= 0]
                here = node[going]
                node[going] = np.where(rows[going, f] < cut[here], left[here], right[here]).astype(np.int64)
            total += length[node]
        return total / len(self.trees)


def _mean_path(n: int) -> float:
    """Mean path below a node that still holds n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _paths(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            keep = [c for c in batch.schema.names if c not in FEATURES]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(forest.path(rows))], names=[*keep, "path"])
    return run


def threshold(counts: list[tuple[int, int, int]], good_loss: float) -> int:
    """The path length, in hundredths, below which a document goes: fewest errors, a good row lost counting ten
    times a bad one kept, and at most a share ``good_loss`` of the good rows lost. Rows: (path, good, bad)."""
    good = sum(g for _, g, _ in counts)
    lost = caught = 0
    best, cut = 0, 0
    for path, g, b in sorted(counts):
        lost, caught = lost + g, caught + b
        if lost > good_loss * good:
            break
        if caught - 10 * lost > best:
            best, cut = caught - 10 * lost, path + 1
    return cut


def judge_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, trees: int = 200, sample: int = 256, depth: int = 20,
    good_loss: float = 0.005, seed: int = 5,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, path.

    ``labels`` has (doc_id, quality). At most ``fit_rows`` good labelled rows, the first by a hash of doc_id,
    fit the forest; without any, or without bad ones, only the base rules decide. A null text has no words
    and fails; equal rows are judged alike. No rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    stats_path = write_scratch(texts.mapInArrow(_statistics, SCHEMA), "quality-statistics")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = spark.read.parquet(stats_path).withColumn("base_failed", base_failed)
    passed = rows.where(~F.col("base_failed"))
    known = one_label(labels, "quality")
    labelled = passed.join(known, F.col("doc_id") == F.col("_labelled"))
    fit = labelled.where("_label = 1").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(fit_rows).select(*FEATURES).collect()
    result = ["doc_id", *RULES, "base_failed"]
    if not fit:
        return rows.select(*result, (~F.col("base_failed")).alias("kept"), F.lit(0.0).alias("path"))
    box = passed.agg(*[F.min(c).alias(f"lo_{c}") for c in FEATURES], *[F.max(c).alias(f"hi_{c}") for c in FEATURES]).first()
    forest = Forest(
        np.array([list(r) for r in fit]), np.array([box[f"lo_{c}"] for c in FEATURES]), np.array([box[f"hi_{c}"] for c in FEATURES]),
        trees, sample, depth, seed)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in RULES) + ", base_failed boolean, path double"
    scored_path = write_scratch(rows.mapInArrow(_paths(forest), schema), "quality-paths")
    drop_scratch(spark, stats_path)
    scored = spark.read.parquet(scored_path)
    level = F.floor(F.col("path") * 100).cast("int")
    counts = scored.where("NOT base_failed").join(known, F.col("doc_id") == F.col("_labelled")).groupBy(level.alias("level")).agg(
        F.sum("_label").alias("good"), F.sum(1 - F.col("_label")).alias("bad")).collect()
    cut = threshold([tuple(r) for r in counts], good_loss)
    return scored.select(*result, (~F.col("base_failed") & (level >= cut)).alias("kept"), "path")
