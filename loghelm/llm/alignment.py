"""Alignment of the tokens that two tokenizers make of the same bytes.

Both tokenizations of a text are kept as their tokens' end offsets. The shorter list of a
text drives the search: each of its ends is looked up in the longer list by steps that
double from a guess, then by halving between the last two, for all ends of many texts at
once. Ends found in both lists cut the tokens into groups; between two ends of the
shorter list, the difference of their ranks in the longer one gives the range of tokens
that overlap.

How often the corpus links two ids is needed to judge each link, so texts are worked on
in chunks: a chunk sends its distinct id pairs once, with counts, and gets a total and a
flag for each of them back; its links stay where they are, as places in its list of pairs.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, write_scratch

CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 20_000
UNITS_KEPT = 120_000
TOKENS_KEPT = 4_000_000
IN_A_ROW = 256
LOOSE = re.compile(r" (?=\s|\Z)")  # a space with nothing visible behind it
CHUNKS = ("chunk long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, "
          "groups_sha256 array<string>, pairs array<long>, counts array<int>, links binary")
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_WORKER: dict = {}


class ByteTokens:
    """A byte-level tokenizer: ids of texts and the bytes of each id."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        # printable bytes stand for themselves, the others for the characters from 256 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Each text with a space before it."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceTokens:
    """A piece tokenizer that puts a space before a text: ids of texts and the bytes of each id."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        piece = self.model.id_to_piece
        self.bytes = [
            bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode()
            for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Row:
    """Units that any text could hold in a row: their numbers, the text, its bytes behind a space, and where each ends there."""

    def __init__(self, numbers: list[int], units: list[str]):
        self.units, listed = numbers, [units[i] for i in numbers]
        self.text = " ".join(listed)
        self.raw = b" " + self.text.encode()
        plain = len(self.raw) == len(self.text) + 1
        self.ends = np.cumsum([len(u) + 1 for u in listed] if plain else [len(u.encode()) + 1 for u in listed])


def in_rows(units: list[str]) -> tuple[list[Row], list[int]]:
    """Rows of the units that begin and end with something visible, and the numbers of the others."""
    joined = [u != "" and u.strip() == u for u in units]
    order = [i for i, j in enumerate(joined) if j]
    return [Row(order[at:at + IN_A_ROW], units) for at in range(0, len(order), IN_A_ROW)], [i for i, j in enumerate(joined) if not j]


class Units:
    """Ids of a text's units: a space and what follows up to the next single space before something visible.

    Neither tokenizer joins bytes across such a space, so a text's ids are its units' ids in a row; both split
    there in any text, the first by its pattern, the second as no piece has a space behind another character.
    Units are encoded once, and kept.
    """

    def __init__(self, tokenizer: ByteTokens | PieceTokens):
        self.tokenizer = tokenizer
        self.sizes = np.array([len(b) for b in tokenizer.bytes], np.int64)
        self.letters, self.letter_at = np.frombuffer(b"".join(tokenizer.bytes), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.clear()

    def clear(self) -> None:
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.right = np.zeros(0, bool)

    def learn(self, units: list[str], rows: list[Row], apart: list[int]) -> None:
        """Append units; ``right`` marks those whose tokens' bytes are a space and the unit.

        ``rows`` are encoded in a row and cut apart by their bytes; where these don't come out, and ``apart``, each unit
        is encoded alone.
        """
        counts, right, made = np.zeros(len(units), np.int64), np.zeros(len(units), bool), []
        placed, apart = [], list(apart)
        for at in range(0, len(rows), 16):
            some = rows[at:at + 16]
            for row, ids in zip(some, self.tokenizer.encode([r.text for r in some])):
                ids = np.array(ids, np.int32)
                ends = np.cumsum(self.sizes[ids])
                cut = np.searchsorted(ends, row.ends)
                if len(ids) and ends[-1] == row.ends[-1] and (ends[cut] == row.ends).all() and self._spelt(ids) == row.raw:
                    counts[row.units], right[row.units] = np.diff(cut + 1, prepend=0), True
                    made.append(ids)
                    placed += row.units
                else:
                    apart += row.units
        for at in range(0, len(apart), 500):
            some = apart[at:at + 500]
            for i, ids in zip(some, self.tokenizer.encode([units[i] for i in some])):
                ids = np.array(ids, np.int32)
                counts[i], right[i] = len(ids), self._spelt(ids) == b" " + units[i].encode()
                made.append(ids)
        start = np.empty(len(units), np.int64)
        listed = np.array([*placed, *apart], np.int64)
        start[listed] = len(self.ids) + np.cumsum(counts[listed]) - counts[listed]
        self.start, self.count = np.concatenate([self.start, start]), np.concatenate([self.count, counts])
        self.right = np.concatenate([self.right, right])
        self.ids = np.concatenate([self.ids, *made])

    def _spelt(self, ids: np.ndarray) -> bytes:
        return self.letters[ranges(self.letter_at[ids], self.sizes[ids])].tobytes()

    def of(self, units: np.ndarray) -> np.ndarray:
        """The ids of these units in a row."""
        return self.ids[ranges(self.start[units], self.count[units])]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair of start and count, in a row."""
    ahead = np.cumsum(count) - count
    return np.repeat(start - ahead, count) + np.arange(int(count.sum()))


def units_of(text: str) -> list[str]:
    """What follows each space of ``' ' + text`` that has no space on its left and something visible on its right."""
    parts = text.split(" ")
    if parts[0] and not LOOSE.search(text):
        return parts
    out, held = [], [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace() and held[-1]:
            out.append(" ".join(held))
            held = [p]
        else:
            held.append(p)
    return [*out, " ".join(held)]


def gallop(wanted: np.ndarray, guess: np.ndarray, listed: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each wanted value, the first place in low..high-1 of the sorted list that holds it or more.

    Steps that double from the guess, forward or backward, bracket the place; halving finds it. Every value's last
    listed one in range has to reach it.
    """
    guess = np.clip(guess, low, high - 1)
    ahead = listed[guess] < wanted  # the place is behind the guess in the list, else at it or before it
    left, right = np.where(ahead, guess, low - 1), np.where(ahead, high - 1, guess)  # listed[left] < wanted <= listed[right]
    going, step = np.arange(len(wanted)), 1
    while len(going):
        up = ahead[going]
        at = np.clip(guess[going] + np.where(up, step, -step), low[going], high[going] - 1)
        less = listed[at] < wanted[going]
        left[going] = np.where(less, np.maximum(left[going], at), left[going])
        right[going] = np.where(less, right[going], np.minimum(right[going], at))
        ended = np.where(up, ~less | (at == high[going] - 1), less | (at == low[going]))
        going, step = going[~ended], step * 2
    open_ = np.flatnonzero(right - left > 1)
    while len(open_):
        mid = (left[open_] + right[open_]) // 2
        less = listed[mid] < wanted[open_]
        left[open_], right[open_] = np.where(less, mid, left[open_]), np.where(less, right[open_], mid)
        open_ = open_[right[open_] - left[open_] > 1]
    return right


def _side(ends: np.ndarray, first: np.ndarray, other: np.ndarray, other_first: np.ndarray, texts: np.ndarray):
    """For the tokens of these texts: (token, first and last token of the other list that overlap it, does it end with one)."""
    count = first[texts + 1] - first[texts]
    token = ranges(first[texts], count)
    low, high = np.repeat(other_first[texts], count), np.repeat(other_first[texts + 1], count)
    begin = np.repeat(first[texts], count)
    # both lists span the same bytes: a rank's share of its list is the guess in the other
    guess = low + (token - begin) * (high - low) // np.maximum(np.repeat(count, count), 1)
    last = gallop(ends[token], guess, other, low, high)
    meets = other[last] == ends[token]
    start = np.where(token == begin, low, np.concatenate([[0], last[:-1] + meets[:-1]]) if len(last) else last)
    return token, start, last, meets


def overlaps(
    ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B) of all links by text, and the ends both lists share as (place in A, place in B).

    Ends grow over all texts; ``first`` is the place of each text's first token, one entry more than texts. Both
    lists of a text end at the same byte.
    """
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    short_a = n_a <= n_b
    parts = []
    for by_a in (True, False):
        texts = np.flatnonzero((short_a == by_a) & (n_a > 0))
        if not len(texts):
            continue
        own = (ends_a, first_a, ends_b, first_b) if by_a else (ends_b, first_b, ends_a, first_a)
        token, start, last, meets = _side(*own, texts)
        many = last - start + 1
        mine, theirs = np.repeat(token, many), ranges(start, many)
        pair = (mine, theirs, token[meets], last[meets])
        parts.append(pair if by_a else (theirs, mine, last[meets], token[meets]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    a, b, cut_a, cut_b = (np.concatenate(p) for p in zip(*parts))
    if len(parts) > 1:  # back to the order of texts
        order, cuts = np.lexsort((b, a)), np.argsort(cut_a, kind="stable")
        return a[order], b[order], cut_a[cuts], cut_b[cuts]
    return a, b, cut_a, cut_b


class Aligner:
    """Chunks of texts to rows of CHUNKS."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = Units(ByteTokens(spec)), Units(PieceTokens(model))
        self.known: dict[str, int] = {}
        self.width = len(self.b.sizes)
        shift = len(self.a.sizes)
        self.shift = 2 * shift  # A's ids with ',' and with '|' behind, then B's with ',' and with ';'
        self.written = [f"{i}{m}" for n, m in ((shift, ","), (shift, "|"), (self.width, ","), (self.width, ";")) for i in range(n)]

    def forget(self) -> None:
        self.known = {}
        self.a.clear()
        self.b.clear()

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts' units in a row, and how many each text has; the empty text has none."""
        split = [units_of(t) if t else [] for t in texts]
        if len(self.known) > UNITS_KEPT or len(self.a.ids) > TOKENS_KEPT:
            self.forget()
        known = self.known
        new = [u for u in set(chain.from_iterable(split)) if u not in known]
        known.update(zip(new, range(len(known), len(known) + len(new))))
        rows, apart = in_rows(new)
        self.a.learn(new, rows, apart)
        self.b.learn(new, rows, apart)
        many = np.array([len(u) for u in split], np.int64)
        return np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(many.sum())), many

    def chunk(self, name: int, doc_ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        n = len(texts)
        units, many = self._units(texts)
        of = np.repeat(np.arange(n), many)
        wrong = np.zeros(n, bool)
        wrong[of[~(self.a.right & self.b.right)[units]]] = True
        units, of = units[~wrong[of]], of[~wrong[of]]  # a text whose bytes are not met has no tokens
        ids, first, ends = {}, {}, {}
        for side, own in (("a", self.a), ("b", self.b)):
            ids[side] = own.of(units)
            first[side] = np.concatenate([[0], np.cumsum(np.bincount(of, own.count[units], n).astype(np.int64))])
            ends[side] = np.cumsum(own.sizes[ids[side]])
        link_a, link_b, cut_a, cut_b = overlaps(ends["a"], first["a"], ends["b"], first["b"])
        text_of = lambda cut: np.searchsorted(first["a"], cut, "right") - 1
        pair = ids["a"][link_a].astype(np.int64) * self.width + ids["b"][link_b]
        pairs, links, counts = np.unique(pair, return_inverse=True, return_counts=True)
        n_links = np.bincount(text_of(link_a), minlength=n)
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([name]), "doc_id": pa.array([doc_ids], pa.list_(pa.int64())),
            "n_a": _one(np.diff(first["a"])), "n_b": _one(np.diff(first["b"])),
            "n_groups": _one(np.bincount(text_of(cut_a), minlength=n)), "n_links": _one(n_links),
            "groups_sha256": pa.array([self._digests(ids, first, cut_a, cut_b)], pa.list_(pa.string())),
            "pairs": _one(pairs, pa.int64()), "counts": _one(counts), "links": pa.array([links.astype(_place(len(pairs))).tobytes()], pa.binary())})

    def _digests(self, ids: dict, first: dict, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
        """Of each text, the digest of its groups as text; '' without tokens."""
        last_a, last_b = np.zeros(len(ids["a"]), bool), np.zeros(len(ids["b"]), bool)
        last_a[cut_a] = last_b[cut_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ahead_a, ahead_b = np.concatenate([[0], cut_a + 1]), np.concatenate([[0], cut_b + 1])  # tokens up to each group
        row = np.empty(len(last_a) + len(last_b), np.int64)
        row[np.arange(len(last_a)) + ahead_b[group_a]] = ids["a"] + last_a * (self.shift // 2)
        row[np.arange(len(last_b)) + ahead_a[group_b + 1]] = ids["b"] + self.shift + last_b * self.width
        bounds, out = (first["a"] + first["b"]).tolist(), []
        written = self.written.__getitem__
        for begin, end in zip(bounds, bounds[1:]):
            out.append(sha256("".join(map(written, row[begin:end].tolist()))[:-1].encode()).hexdigest() if end > begin else "")
        return out


def _place(pairs: int) -> str:
    """The type that holds a place among so many pairs."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


def _one(values: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _chunks(spec: Callable[[], str], model: Callable[[], bytes], chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _WORKER.get("of") != (spec(), model()):
            _WORKER.update(of=(spec(), model()), aligner=Aligner(spec(), model()))
        aligner: Aligner = _WORKER["aligner"]
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        texts: list[str] = []
        held = 0
        slices = (batch.slice(at, 500) for batch in batches for at in range(0, batch.num_rows, 500))
        for batch in slices:
            raw = batch.column("text").cast(pa.large_binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw):
                text = text.as_py()
                doc_ids.append(doc_id)
                try:
                    texts.append(text.decode())
                except UnicodeDecodeError:  # no tokens can give these bytes back
                    texts.append("")
                held += len(text)
                if held >= chunk_bytes or len(texts) >= CHUNK_DOCS:
                    yield aligner.chunk(part << 32 | number, doc_ids, texts)
                    doc_ids, texts, held, number = [], [], 0, number + 1
        if doc_ids:
            yield aligner.chunk(part << 32 | number, doc_ids, texts)
        aligner.forget()  # an idle worker holds no units
    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of OUT from chunks and what the corpus says of their pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            lists = {c: row.column(c).flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")}
            told = row.column("told").flatten()  # pair, total, best
            pair, total, best = (told.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.argsort(pair)  # pairs of a chunk are sorted
            links = np.frombuffer(row.column("links")[0].as_buffer(), _place(len(lists["pairs"])))
            bounds = np.concatenate([[0], np.cumsum(lists["n_links"].to_numpy(), dtype=np.int64)])
            sums, hits = (np.diff(np.concatenate([[0], np.cumsum(v[order][links], dtype=np.int64)])[bounds]) for v in (total, best))
            yield pa.RecordBatch.from_pydict({
                "doc_id": lists["doc_id"], **{c: pc.cast(lists[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                "n_best": pa.array(hits), "count_sum": pa.array(sums), "groups_sha256": lists["groups_sha256"]})


def align_tokens(
    docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    A is the tokenizer of ``byte_path`` on a space and the text, B that of ``piece_path`` on the text; both files are
    read on the driver. Null and empty texts, and those whose tokens' bytes are not a space and the text, have no
    tokens: zeros and ''. Equal rows and null doc_ids each get their row; a text of any length is one chunk at
    least. No rows give no rows.
    """
    import public_tokenizers

    spark = docs.sparkSession
    with open(byte_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    with open(piece_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    width = len(PieceTokens(model.value).bytes)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    made = texts.mapInArrow(_chunks(lambda: spec.value, lambda: model.value, chunk_bytes), CHUNKS)
    path = write_scratch(made, "alignment-chunks")
    chunks = spark.read.parquet(path)
    listed = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("one")).select(
        "chunk", F.col("one.pairs").alias("pair"), F.col("one.counts").alias("count"))
    totals = listed.groupBy("pair").agg(F.sum("count").alias("total")).withColumn("b", F.col("pair") % width)
    totals_path = write_scratch(totals, "alignment-totals")
    totals = spark.read.parquet(totals_path)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))  # a row for each id of B's vocabulary at most
    judged = totals.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    told = listed.join(judged.hint("merge"), "pair").groupBy("chunk").agg(
        F.collect_list(F.struct("pair", "total", "best")).alias("told"))
    return chunks.drop("counts").join(told.hint("merge"), "chunk", "left").mapInArrow(_settle, OUT)
