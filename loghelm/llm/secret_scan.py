"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests can't tell from random ones.

Every long run of token characters is tested, and so are the long parts it has
between the marks / - _ + (cut at any set of them) and what is left of either
without the words around it. Each is read in the smallest alphabet that holds it
(digits, letters of one case, hex, base32, base36, base62, base64, base64url):
a random token of a larger alphabet that fits a smaller one is random in that
one too. Three tests look for departures from uniform, independent symbols:
chi-squared on symbol counts, the number of runs of character classes, and the
lag-one serial correlation. Fisher's method combines them. Within each encoding
and class of lengths, over all documents, Benjamini and Hochberg's rule finds
the tokens that are not random, so that at most a share ``fdr`` of those set
aside are random ones; of what is left, the longest that do not overlap are
reported as kind ``random``. Classes of lengths are judged apart because the
tests' power grows with the length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import saved

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "random"]
STEMS = ("passw", "secret", "token", "api")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
MARKS = "/-_+"
# Words ahead of a token, and, in reversed text, behind it: what a random token rarely has between an end and a mark.
AHEAD = re.compile(r"(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{3,}|[A-Za-z]?[0-9]+)?[/_+-]+)+")
BEHIND = re.compile(r"(?:(?:[a-z]{2,}[A-Z]?|[A-Z]{3,}|[0-9]+[A-Za-z]?)?[/_+-]+)+")
ENCODINGS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("letters_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
LENGTH_CLASSES = [20, 24, 32, 40, 64, 128]
STEP = 0.01
SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, tokens array<struct<start:long,end:long,stratum:int,level:int,wordy:boolean>>"
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def _symbol_class(ch: str, alphabet: str) -> int:
    """Digit, upper, lower, mark; small and large digits, vowels and other letters where there is nothing else."""
    if alphabet.isdigit():
        return int(ch >= "5")
    if alphabet.isalpha() and len(alphabet) == 26:
        return int(ch in "AEIOUYaeiouy")
    return 0 if ch.isdigit() else 1 if ch.isupper() else 2 if ch.islower() else 3


class Encoding:
    def __init__(self, number: int, alphabet: str):
        self.number, self.size = number, len(alphabet)
        self.index = np.full(256, -1)
        self.klass = np.full(256, -1)
        for i, ch in enumerate(alphabet):
            self.index[ord(ch)], self.klass[ord(ch)] = i, _symbol_class(ch, alphabet)
        share = np.bincount([_symbol_class(ch, alphabet) for ch in alphabet]) / len(alphabet)
        self.q2, self.q3 = float((share**2).sum()), float((share**3).sum())
        self.ranges = re.compile(f"[{re.escape(alphabet)}]+")


CODINGS = [Encoding(i, a) for i, (_, a) in enumerate(ENCODINGS)]


def infer(token: str) -> Encoding | None:
    """The smallest encoding that holds the token; None for both + or / and - or _, which no encoding has."""
    return next((e for e in CODINGS if e.ranges.fullmatch(token)), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, code: Encoding) -> float:
    """Combined p-value of the battery; small means not random."""
    raw = np.frombuffer(token.encode("ascii"), np.uint8)
    x, n, size = code.index[raw], len(raw), code.size
    counts = np.bincount(x, minlength=size)
    chi = size / n * float((counts.astype(float) ** 2).sum()) - n
    p_chi = _normal_tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n)))
    klass = code.klass[raw]
    changes = int((klass[1:] != klass[:-1]).sum())
    spread = (n - 1) * code.q2 * (1 - code.q2) + 2 * (n - 2) * (code.q3 - code.q2**2)
    p_runs = 2 * _normal_tail(abs(changes - (n - 1) * (1 - code.q2)) / math.sqrt(max(spread, 1e-9)))
    centred = x - x.mean()
    total = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / total if total else 1.0
    p_serial = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    t = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return min(1.0, math.exp(-t) * (1 + t + t * t / 2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = []
    lower = text.lower()
    if any(s in lower for s in STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if RUN.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def _core(text: str) -> tuple[int, int]:
    """Where the text starts and ends without the words and marks around it."""
    ahead, behind = AHEAD.match(text), BEHIND.match(text[::-1])
    return ahead.end() if ahead else 0, len(text) - (behind.end() if behind else 0)


def parts(run: str) -> dict[tuple[int, int], bool]:
    """Places of the run, of its parts between any set of marks and of their cores, if long; whether words are around it."""
    marks, found = [m for m in MARKS if m in run], {}
    for n in range(len(marks) + 1):
        for cut in combinations(marks, n):
            at = 0
            for piece in re.split(f"[{re.escape(''.join(cut))}]", run) if cut else [run]:
                if len(piece) >= LENGTH_CLASSES[0]:
                    a, b = _core(piece)
                    found[at, at + len(piece)] = (a, b) != (0, len(piece))
                    if b - a >= LENGTH_CLASSES[0]:
                        found[at + a, at + b] = False
                at += len(piece) + 1
    return found


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Candidate tokens clear of base spans: place, stratum, -log10 of the p-value in steps, and whether words are around it."""
    found, starts = [], [a for a, _, _ in base]
    ends = list(accumulate((b for _, _, b in base), max))
    for m in CANDIDATE.finditer(text):
        for (a, b), wordy in parts(m[0]).items():
            token, start, end = m[0][a:b], m.start() + a, m.start() + b
            before = bisect_left(starts, end)
            code = infer(token)
            if code is None or before and ends[before - 1] > start:
                continue
            length_class = sum(b - a >= c for c in LENGTH_CLASSES)
            level = int(min(300.0, -math.log10(max(randomness(token, code), 1e-300))) / STEP)
            found.append({"start": start, "end": end, "stratum": code.number * 10 + length_class, "level": level, "wordy": wordy})
    return found


def longest(found: list[dict]) -> list[tuple[int, int]]:
    """Places of the longest tokens that do not overlap; one with words around it gives way to any without."""
    chosen: list[tuple[int, int]] = []
    for t in sorted(found, key=lambda t: (t["wordy"], t["start"] - t["end"], t["start"])):
        i = bisect_left(chosen, (t["start"], t["end"]))
        if (i == 0 or chosen[i - 1][1] <= t["start"]) and (i == len(chosen) or t["end"] <= chosen[i][0]):
            chosen.insert(i, (t["start"], t["end"]))
    return chosen


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    token = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("level", pa.int32()), ("wordy", pa.bool_())])
    for batch in batches:
        base, found, sha, counts = [], [], [], []
        for text in batch.column("text"):
            text = text.as_py()
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            found.append(tokens(text, spans) if RUN.search(text) else [])
            said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            sha.append(hashlib.sha256(said.encode()).hexdigest())
            counts.append([sum(k == kind for _, k, _ in spans) for kind in range(3)])
        n = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(n[:, i]) for i in range(3)), pa.array(sha, pa.string()),
             pa.array(base, pa.list_(span)), pa.array(found, pa.list_(token))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens"])


def dismissed_from(levels: dict[int, int], fdr: float) -> int:
    """The least level at which tokens are set aside as not random; levels are -log10 p in steps, with their counts."""
    total, above, cut = sum(levels.values()), 0, 2**31 - 1
    for level in sorted(levels, reverse=True):
        above += levels[level]
        if 10 ** (-level * STEP) <= fdr * above / total:
            cut = level
    return cut


def _told(cuts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, n_random = [], []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("tokens").to_pylist()):
                random = longest([t for t in found if t["level"] < cuts[t["stratum"]]])
                spans = [(s["start"], s["kind"], s["end"]) for s in base] + [(a, 3, b) for a, b in random]
                said.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)))
                n_random.append(len(random))
            same = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in same), pa.array(said, pa.string()), pa.array(n_random, pa.int64())],
                names=[*same, "spans", "n_random"])
    return run


def find_secrets(docs: DataFrame, fdr: float = 0.1) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are not read): doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_random.

    Spans are code points, end exclusive, written kind:start:end, by start, then kind, comma-joined. Random
    tokens that overlap a base span are not added. A null text counts as empty; equal rows give equal rows.
    The thresholds come from counts over all documents, a few thousand numbers at any size.
    """
    scanned = saved(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scan, SCANNED), "secret-scan")
    counts = scanned.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.level").count()
    by_stratum: dict[int, dict[int, int]] = {}
    for stratum, level, n in counts.collect():
        by_stratum.setdefault(stratum, {})[level] = n
    cuts = {s: dismissed_from(levels, fdr) for s, levels in by_stratum.items()}
    return scanned.mapInArrow(_told(cuts), FOUND)
