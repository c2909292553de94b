"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Votes are
counted over all documents by vote pattern, and expectation-maximisation on
these counts estimates the share of good documents and how often each labeller
says what of good and of bad ones; no given label is used. Every pattern's
posterior then labels its documents, and a linear scorer on hashed word shapes,
single and in pairs, is trained on a bounded sample and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import matching, text_keys, write_scratch
from loghelm.llm.text_stats import stats
from loghelm.llm.words import Texts, mix

BUCKETS = 1 << 13
SCHEMA = "doc_id long, crc long, hash long, pattern int, slots binary, weights binary"
# says bad above, says good below
LABELLERS = {
    "symbols": (0.20, 0.02), "repeats": (0.50, 0.20), "dup_lines": (0.30, 0.00), "upper": (0.50, 0.20),
    "marks": (0.30, 0.05), "marked_words": (0.30, 0.05), "mark_chars": (0.12, 0.03), "top": (0.40, 0.20), "unended": (0.995, 0.98), "same_words": (0.35, 0.25),
}

_CLASS = np.full(256, 2, np.uint8)  # lower-case letters, and letters beyond ASCII
_CLASS[65:91], _CLASS[48:58] = 1, 3
for _i in range(33, 127):
    if not chr(_i).isalnum():
        _CLASS[_i] = _i


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One column a labeller: 1 good, 0 bad, 2 no vote. Under 20 words only the shares of marks vote."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    measured = {
        "symbols": s["n_symbols"] / words, "repeats": s["n_repeat_words"] / words, "dup_lines": s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        "upper": s["n_upper"] / chars, "marks": s["n_marks"] / words, "top": s["n_top"] / words,
        "marked_words": s["n_marked"] / words, "mark_chars": (s["n_symbols"] + s["n_marks"]) / chars,
        "unended": 1 - s["n_ended"] / words, "same_words": 1 - np.log1p(s["n_different"]) / np.log1p(words)}
    out = np.full((len(words), len(LABELLERS)), 2, np.int64)
    for i, (name, (bad, good)) in enumerate(LABELLERS.items()):
        out[measured[name] <= good, i] = 1
        out[measured[name] > bad, i] = 0
        if name in ("repeats", "top", "unended", "same_words", "dup_lines"):
            out[s["n_words"] < 20, i] = 2
    out[s["n_words"] == 0] = 2
    return out


def shapes(t: Texts) -> np.ndarray:
    """A code for each word's shape: runs of upper case, other letters, digits and each mark, written once."""
    kind = _CLASS[t.buf]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[t.starts] = True
    return t.codes(values=kind, keep=keep)


def hashed(t: Texts, s: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: hashed slots and weights of word shapes, pairs of shapes, and steps of repetition; of unit length."""
    code = shapes(t)
    pair = mix(code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:])
    inside = t.doc[:-1] == t.doc[1:]
    slot = np.concatenate([code, pair[inside]]) % np.uint64(BUCKETS)
    doc = np.concatenate([t.doc, t.doc[:-1][inside]])
    key, n = np.unique(doc * BUCKETS + slot.astype(np.int64), return_counts=True)
    begin = np.searchsorted(key, np.arange(t.n + 1) * BUCKETS)
    words = np.maximum(s["n_words"], 1)
    steps = np.stack([10 * s["n_repeat_words"] // words, 10 * s["n_top"] // words, 10 * s["n_dup_lines"] // np.maximum(s["n_lines"], 1)], axis=1)
    out = []
    for i in range(t.n):
        own = mix(steps[i].astype(np.uint64) + np.uint64(1000) * np.arange(1, 4, dtype=np.uint64)) % np.uint64(BUCKETS)
        slots = np.concatenate([key[begin[i]:begin[i + 1]] - i * BUCKETS, own.astype(np.int64)])
        weights = np.concatenate([np.sqrt(n[begin[i]:begin[i + 1]] / words[i]), np.full(3, 0.5)])
        out.append((slots.astype(np.uint16), (weights / np.sqrt((weights**2).sum())).astype(np.float32)))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            raw = part.column("text").cast(pa.large_binary()).to_pylist()
            t = Texts(raw)
            s = stats(t, raw)
            features = hashed(t, s)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "crc": part.column("crc"), "hash": part.column("hash"),
                "pattern": pa.array((votes(s) @ base).astype(np.int32)),
                "slots": pa.array([a.tobytes() for a, _ in features], pa.binary()),
                "weights": pa.array([w.tobytes() for _, w in features], pa.binary())})


def unpacked(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def label_model(pattern: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, each labeller's chance of saying bad by class (class, labeller), share of good.

    A labeller without a vote says nothing for or against. The start has bad votes on few good documents, and
    any one labeller blind to most bad ones, as each looks for its own kind of junk.
    """
    said = unpacked(pattern)
    bad, good = (said == 0).astype(float), (said == 1).astype(float)
    share, says_bad = 0.8, np.tile(np.array([[0.25], [0.005]]), (1, said.shape[1]))
    posterior = np.zeros(len(pattern))
    for _ in range(rounds):
        of = bad @ np.log(says_bad).T + good @ np.log(1 - says_bad).T
        odds = of[:, 1] - of[:, 0] + np.log(share) - np.log(1 - share)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        for c, weight in ((1, n * new), (0, n * (1 - new))):
            says_bad[c] = (weight @ bad + 0.5) / (weight @ (bad + good) + 1)
        share = float(np.clip((n * new).sum() / max(n.sum(), 1), 0.01, 0.99))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return posterior, says_bad, share


def fit_linear(slots: list[np.ndarray], weights: list[np.ndarray], label: np.ndarray, rounds: int = 300, rate: float = 4.0, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the constant."""
    sizes = np.array([len(s) for s in slots])
    row, slot, value = np.repeat(np.arange(len(slots)), sizes), np.concatenate(slots).astype(np.int64), np.concatenate(weights).astype(float)
    w, velocity = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        z = np.bincount(row, value * w[slot], len(slots)) + w[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
        grad = np.append(np.bincount(slot, value * off[row], BUCKETS), off.sum()) / len(slots) + ridge * w
        velocity = 0.9 * velocity - rate * grad
        w += velocity
    return w


def _score(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [float((np.frombuffer(v, np.float32) * w[np.frombuffer(s, np.uint16).astype(np.int64)]).sum() + w[-1])
                 for s, v in zip(batch.column("slots").to_pylist(), batch.column("weights").to_pylist())]
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "crc", "hash", "pattern")), pa.array(score)],
                names=["doc_id", "crc", "hash", "pattern", "score"])
    return run


def score_quality(docs: DataFrame, fit_rows: int = 12_000, cut: float = 0.25) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, weak_label, score, kept, and
    crc and hash of the text.

    weak_label is the posterior of the row's votes, score the linear scorer's, kept whether it is at least
    ``cut``. The scorer learns from at most ``fit_rows`` rows, half of them from either side of the
    posterior, the first by a hash of doc_id and text, so that copies of a text enter no more often than
    their share of the rows. A null text counts as empty: nothing votes on it, and its weak label
    is the corpus's share of good rows. Equal rows score alike. No rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *text_keys())
    path = write_scratch(texts.mapInArrow(_read, SCHEMA), "quality-votes")
    rows = spark.read.parquet(path)
    counted = rows.groupBy("pattern").count().orderBy("pattern").collect()
    if not counted:
        return spark.createDataFrame([], "doc_id long, weak_label double, score double, kept boolean, crc long, hash long")
    pattern, n = (np.array(x, np.int64) for x in zip(*[tuple(r) for r in counted]))
    posterior, _, _ = label_model(pattern, n)
    by_pattern = spark.createDataFrame(
        [(int(p), float(x)) for p, x in zip(pattern, posterior)], "pattern int, weak_label double")
    labelled = rows.join(F.broadcast(by_pattern), "pattern")  # at most 3 to the number of labellers rows
    fit = []
    for side in ("weak_label >= 0.5", "weak_label < 0.5"):
        fit += labelled.where(side).orderBy(F.xxhash64("doc_id", "hash"), "crc", "doc_id").limit(fit_rows // 2).select("slots", "weights", "weak_label").collect()
    w = fit_linear([np.frombuffer(r["slots"], np.uint16) for r in fit], [np.frombuffer(r["weights"], np.float32) for r in fit],
                   np.array([r["weak_label"] for r in fit]))
    scored = rows.mapInArrow(_score(w), "doc_id long, crc long, hash long, pattern int, score double")
    return scored.join(F.broadcast(by_pattern), "pattern").select(
        "doc_id", "weak_label", "score", (F.col("score") >= cut).alias("kept"), "crc", "hash")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are."""
    return matching(docs, score_quality(docs, **options).where("kept"), once=False)
