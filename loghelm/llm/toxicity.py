"""Toxicity classifier with a counterfactual penalty.

Features are the words of a text and their beginnings and ends, present or not, if
two labelled documents have them. A logistic regression with an absolute penalty on its
weights chooses among them: only those whose counts lie too near to chance for any
weight are left out before. For labelled documents that name a group, a copy is made
with the identity terms swapped for others, and the fit is penalised by the squared
difference of the two scores, so that naming a group weighs nothing.
The model is fitted on a bounded sample of labelled rows; tasks turn its texts to
numbers of features, so no text reaches the driver. Every document is scored from its whole
text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, one_label, write_scratch
from loghelm.llm.words import Texts, mix

# Groups that can stand for one another in a sentence.
IDENTITY_TERMS = (
    ("woman", "man"), ("women", "men"), ("female", "male"), ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frau", "mann"), ("frauen", "männer"), ("christ", "moslem", "jude", "buddhist"), ("christen", "muslime", "juden", "buddhisten"),
    ("schwarze", "weiße", "asiatische"), ("schwul", "lesbisch", "hetero"), ("ausländer", "inländer", "flüchtling"),
    ("femme", "homme"), ("femmes", "hommes"), ("chrétien", "musulman", "juif", "bouddhiste"), ("chrétiens", "musulmans", "juifs", "bouddhistes"),
    ("noire", "blanche", "asiatique"), ("immigré", "citoyen", "réfugié"), ("immigrés", "citoyens", "réfugiés"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("cristiano", "musulmán", "judío", "budista"), ("cristianos", "musulmanes", "judíos", "budistas"),
    ("negra", "blanca", "asiática"), ("inmigrante", "ciudadano", "refugiado"), ("inmigrantes", "ciudadanos", "refugiados"),
)
HELD_OUT_OF = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
for _i in range(33, 127):
    _EDGE[_i] = not chr(_i).isalnum()


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null doc_id is one of them."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(HELD_OUT_OF)) == 0


def feature_codes(t: Texts) -> list[np.ndarray]:
    """For each word, in lower case and without marks at its edges: codes of it, its beginnings and its ends."""
    starts, ends = t.starts.copy(), t.ends.copy()
    for _ in range(4):
        inner = starts + 1 < ends
        ends -= inner & _EDGE[t.buf[ends - 1]]
        inner = starts + 1 < ends
        starts += inner & _EDGE[t.buf[starts]]
    low = _LOWER[t.buf]
    out = [t.codes(values=low, spans=(starts, ends))]
    for k, n in enumerate((4, 5, 6)):
        for j, span in enumerate(((starts, np.minimum(starts + n, ends)), (np.maximum(ends - n, starts), ends))):
            out.append(mix(t.codes(values=low, spans=span) + np.uint64(1 + 2 * k + j)))
    return out


def swapped(text: bytes, number: int, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> bytes | None:
    """The text with every identity term replaced by another of its group; None if it names none."""
    other = {}
    for group in terms:
        for i, term in enumerate(group):
            other.setdefault(term.encode(), group[(i + 1 + number % (len(group) - 1)) % len(group)].encode())
    listed = b"|".join(sorted(other, key=len, reverse=True))
    pattern = re.compile(rb"(?<![A-Za-z\x80-\xff])(" + listed + rb")(?![A-Za-z\x80-\xff])", re.I)
    new, n = pattern.subn(lambda m: other[m[1].lower()], text)
    return new if n else None


def _present(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, code), each code once a text."""
    code = np.concatenate(feature_codes(t))
    doc = np.tile(t.doc, 7)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], code[new]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            label = part.column("label").to_numpy(zero_copy_only=False)
            doc, code = _present(Texts(part.column("text").cast(pa.large_binary()).to_pylist()))
            codes, of = np.unique(code, return_inverse=True)
            toxic = np.bincount(of, label[doc], len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "code": pa.array(codes.view(np.int64)), "toxic": pa.array(toxic),
                "clean": pa.array(np.bincount(of, minlength=len(codes)) - toxic)})


class Model:
    """Weights of codes; the codes are sorted."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, constant: float):
        self.codes, self.weights, self.constant = codes, weights, constant
        self.may = np.zeros(1 << 20, bool)
        self.may[(codes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of the code), each once."""
        docs, places = [], []
        for code in feature_codes(t):
            at = np.flatnonzero(self.may[(code >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.codes, code[at]), max(len(self.codes) - 1, 0))
            right = self.codes[place] == code[at] if len(self.codes) else np.zeros(len(at), bool)
            docs.append(t.doc[at[right]])
            places.append(place[right])
        n = max(len(self.codes), 1)
        key = np.unique(np.concatenate(docs) * n + np.concatenate(places))
        return key // n, key % n

    def score(self, t: Texts) -> np.ndarray:
        doc, place = self.hits(t)
        z = np.bincount(doc, self.weights[place], t.n) + self.constant if len(doc) else np.full(t.n, self.constant)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], label: np.ndarray, codes: np.ndarray, share: float, penalty: float = 1.0) -> Model:
    """A model of these codes from texts and their labels (0 or 1); see ``fit_hits``."""
    model = Model(np.sort(codes), np.zeros(len(codes)), 0.0)
    pairs = [(i, s) for i, text in enumerate(texts) if (s := swapped(text, zlib.crc32(text))) is not None]
    doc, place = model.hits(Texts(texts))
    other_doc, other_place = model.hits(Texts([s for _, s in pairs])) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    of = np.array([i for i, _ in pairs], np.int64)
    return fit_hits(model.codes, label, (doc, place), (of[other_doc], other_place), of, share, penalty)


def fit_hits(
    codes: np.ndarray, label: np.ndarray, hits: tuple[np.ndarray, np.ndarray], swapped_hits: tuple[np.ndarray, np.ndarray],
    pairs: np.ndarray, share: float, penalty: float = 1.0, strength: float = 0.01, ridge: float = 5e-4, rounds: int = 300,
) -> Model:
    """Logistic regression whose loss adds ``penalty`` times the squared score change under swapped identity terms.

    ``hits`` and ``swapped_hits`` are (row, feature) of the texts and of the copies of the rows ``pairs``. The weights'
    absolute values cost ``strength`` / sqrt(rows) each, their squares ``ridge``; accelerated steps, started anew
    where one overshoots. Features without a weight are left out of the model.
    """
    row, slot = hits
    n, k = len(label), len(codes)
    number = np.full(n, -1)
    number[pairs] = np.arange(len(pairs))
    own = number[row] >= 0
    d_row = np.concatenate([number[row[own]], number[swapped_hits[0]]])
    d_slot = np.concatenate([slot[own], swapped_hits[1]])
    d_sign = np.concatenate([np.ones(own.sum()), -np.ones(len(swapped_hits[0]))])
    weight = np.where(label == 1, share / max(label.mean(), 1e-9), (1 - share) / max(1 - label.mean(), 1e-9)) / n
    cost = strength / n**0.5

    def curved(x: np.ndarray) -> np.ndarray:
        """A bound on the loss's second derivative times x."""
        z = np.bincount(row, x[slot], n)
        change = np.bincount(d_row, d_sign * x[d_slot], len(pairs))
        return np.bincount(slot, (0.25 * weight * z)[row], k) + penalty / n * np.bincount(d_slot, d_sign * change[d_row], k) + ridge * x

    v, most = np.ones(k), 1.0
    for _ in range(20):
        v = curved(v / np.linalg.norm(v))
        most = max(np.linalg.norm(v), 1e-12)
    step = 1 / (1.1 * most)
    w = ahead = np.zeros(k)
    b, t = np.log(max(share, 1e-9) / max(1 - share, 1e-9)), 1.0
    for _ in range(rounds):
        z = np.bincount(row, ahead[slot], n) + b
        off = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        change = np.bincount(d_row, d_sign * ahead[d_slot], len(pairs))
        grad = np.bincount(slot, off[row], k) + penalty / n * np.bincount(d_slot, d_sign * change[d_row], k) + ridge * ahead
        b -= 2 * off.sum()
        new = ahead - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * cost, 0)
        if ((ahead - new) * (new - w)).sum() > 0:
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    kept = w != 0
    return Model(codes[kept], w[kept], float(b))


def calibrated(
    codes: np.ndarray, label: np.ndarray, hits: tuple[np.ndarray, np.ndarray], swapped_hits: tuple[np.ndarray, np.ndarray],
    pairs: np.ndarray, share: float, penalty: float = 1.0, folds: int = 3,
) -> Model:
    """``fit_hits``, its margins scaled and shifted so that scores of rows left out of a fit are right on average.

    The absolute penalty holds margins near the constant; folds of the rows show by how much. The two numbers
    are fitted by Newton steps, drawn to (1, 0) as by one more row.
    """
    model = fit_hits(codes, label, hits, swapped_hits, pairs, share, penalty)
    n = len(label)
    margin = np.zeros(n)
    fold = np.arange(n) % folds
    for f in range(folds):
        inside = np.flatnonzero(fold != f)
        if not 0 < label[inside].sum() < len(inside):
            return model
        at = np.full(n, -1)
        at[inside] = np.arange(len(inside))
        part = lambda hit: (at[hit[0][at[hit[0]] >= 0]], hit[1][at[hit[0]] >= 0])  # noqa: B023, E731
        left = pairs[fold[pairs] != f] if len(pairs) else pairs
        one = fit_hits(codes, label[inside], part(hits), part(swapped_hits), at[left], share, penalty)
        weight = np.zeros(len(codes))
        weight[np.searchsorted(codes, one.codes)] = one.weights
        margin += np.where(fold == f, np.bincount(hits[0], weight[hits[1]], n) + one.constant, 0)
    each = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    two, x = np.array([1.0, 0.0]), np.column_stack([margin, np.ones(n)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ two, -40, 40)))
        slope = x.T @ (each * (p - label)) + two - [1.0, 0.0]
        two = two - np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.eye(2), slope)
    scale = max(float(two[0]), 0.1)
    return Model(model.codes, model.weights * scale, model.constant * scale + float(two[1]))


def _sample_hits(model: Model):
    """Of each sample row, the features of its text and of its swapped copy (null if it names no group), as numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(texts: list[bytes]) -> list[bytes]:
            doc, place = model.hits(Texts(texts))
            return [p.astype("<i4").tobytes() for p in np.split(place, np.searchsorted(doc, np.arange(1, len(texts))))]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                other = [swapped(t, zlib.crc32(t)) for t in texts]
                made = iter(listed([o for o in other if o is not None]) if any(o is not None for o in other) else [])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "label": part.column("label"), "own": pa.array(listed(texts), pa.binary()),
                    "other": pa.array([None if o is None else next(made) for o in other], pa.binary())})
    return run


def _flat(lists: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of rows' packed features."""
    made = [np.frombuffer(x or b"", "<i4") for x in lists]
    return np.repeat(np.arange(len(made)), [len(m) for m in made]), np.concatenate([np.zeros(0, "<i4"), *made]).astype(np.int64)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                score = model.score(Texts(part.column("text").cast(pa.large_binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])
    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 6_000, most_features: int = 16_384, penalty: float = 1.0,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, held_out, score, predicted.

    ``labels`` has (doc_id, toxic); held-out rows are never learnt from. At most ``fit_rows`` labelled rows of
    each class, the first by a hash of doc_id, fit the model; the share of toxic rows is taken over all
    labelled rows that aren't held out. Of a doc_id that stands on several texts, the text with the smallest
    hash is learnt from. The ``most_features`` features whose counts lie farthest from chance are weighed. Without
    rows of both classes the score is that share, or 0. A null text counts as empty and scores the constant; a
    text of any length is one row. No rows give no rows. To the driver go the features' numbers of the sample's
    rows, ``most_features`` a row at most.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    known = one_label(labels, "toxic").where(~held_out(F.col("_labelled")))
    present = known.join(texts.select("doc_id").distinct(), F.col("doc_id") == F.col("_labelled"), "left_semi")
    path = write_scratch(present, "toxic-labels")
    present = spark.read.parquet(path)
    seen = {r["_label"]: r["count"] for r in present.groupBy("_label").count().collect()}
    share = seen.get(1, 0) / max(sum(seen.values()), 1)
    first = [F.xxhash64("_labelled"), "_labelled"]
    picked = present.where("_label = 1").orderBy(*first).limit(fit_rows).union(
        present.where("_label = 0").orderBy(*first).limit(fit_rows))
    if not (seen.get(0) and seen.get(1)):
        scored = texts.select("doc_id", "held_out", F.lit(float(share)).alias("score"))
    else:
        by_hash = F.struct(F.xxhash64("text"), F.crc32("text"))
        chosen = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_labelled")).groupBy("doc_id").agg(  # at most twice fit_rows rows
            F.first("_label").cast("double").alias("label"), F.min_by("text", by_hash).alias("text"))
        sample_path = write_scratch(chosen, "toxic-sample")
        sample = spark.read.parquet(sample_path)
        n_toxic, n_all = float(min(seen[1], fit_rows)), float(min(seen[1], fit_rows) + min(seen[0], fit_rows))
        part = n_toxic / n_all
        both = F.col("toxic") + F.col("clean")
        counted = sample.mapInArrow(_counts, "code long, toxic long, clean long").groupBy("code").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(both >= 2)
        # how far the toxic count lies from its expectation, in deviations
        far = F.abs(F.col("toxic") - both * part) / F.sqrt(both * part * (1 - part) * (1 - both / (n_all + 1)))
        best = counted.select("code", far.alias("far")).orderBy(F.desc("far"), "code").limit(most_features).collect()
        codes = np.sort(np.array([r["code"] for r in best], np.int64).view(np.uint64))
        empty = Model(codes, np.zeros(len(codes)), 0.0)
        rows = sample.mapInArrow(_sample_hits(empty), "doc_id long, label double, own binary, other binary").orderBy("doc_id").collect()
        pairs = np.array([i for i, r in enumerate(rows) if r["other"] is not None], np.int64)
        model = calibrated(codes, np.array([r["label"] for r in rows]), _flat([r["own"] for r in rows]),
                           _flat([r["other"] for r in rows]), pairs, share, penalty)
        scored = texts.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")
        drop_scratch(spark, sample_path)
    drop_scratch(spark, path)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
