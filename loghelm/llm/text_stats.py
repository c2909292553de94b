"""Counts over whole texts, for many texts at once."""

from __future__ import annotations

import numpy as np

from loghelm.llm.words import Texts, mix

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?|~^=_@/\\+"

_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in (
    ("symbol", SYMBOLS), ("mark", MARKS), ("upper", range(65, 91)), ("digit", range(48, 58)), ("stop", b".!?"))}
_POINT = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points


def _per_text(t: Texts, word_flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(word_flags, dtype=np.int64)])
    return total[t.first[1:]] - total[t.first[:-1]]


def repeated_words(t: Texts, code: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, the words inside windows of ``width`` words that the text holds twice or more."""
    n = len(code) - width + 1
    covered = np.zeros(len(code), bool)
    if n > 0:
        at = np.flatnonzero(t.doc[:n] == t.doc[width - 1:])
        key = t.doc[at].astype(np.uint64)
        for j in range(width):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + code[at + j])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        for j in range(width):
            covered[at[twice] + j] = True
    return _per_text(t, covered)


def distinct_words(t: Texts, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the number of different words and how often the most frequent one occurs."""
    different, top = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
    if len(code):
        key = mix(code + t.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        begin = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        doc = t.doc[order][begin]
        np.add.at(different, doc, 1)
        np.maximum.at(top, doc, np.diff(np.append(begin, len(key))))
    return different, top


def stats(t: Texts, raw: list[bytes]) -> dict[str, np.ndarray]:
    """Counts per text; words are runs of bytes other than space and 09-0D."""
    code = t.codes()
    lines = [[x for x in text.split(b"\n") if x.strip()] for text in raw]
    n_lines = np.array([len(x) for x in lines], np.int64)
    word = ~t.space
    different, top = distinct_words(t, code)
    counts = {name: t.count_by_text(_IS[name][t.buf]) for name in ("symbol", "mark", "upper", "digit")}
    return {
        "n_words": np.diff(t.first), "word_chars": t.count_by_text(word & _POINT[t.buf]), "n_symbols": counts["symbol"],
        "n_lines": n_lines, "n_dup_lines": n_lines - np.array([len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_words(t, code), "n_marks": counts["mark"], "n_upper": counts["upper"],
        "n_digits": counts["digit"], "n_different": different, "n_top": top,
        "n_marked": _per_text(t, (_IS["symbol"] | _IS["mark"])[t.buf[t.ends - 1]]),
        "n_ended": _per_text(t, _IS["stop"][t.buf[t.ends - 1]]),
    }
