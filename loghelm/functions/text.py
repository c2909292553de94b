"""String expressions shared by parsing, cleaning, labelling and features."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything Python's str.split() and str.strip() treat as white space.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NON_WS = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"

# The same characters one by one, which the JVM's engine tests faster than by property.
_SPACES = r"\t-\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE_CHARS, VISIBLE_CHARS = f"[ {_SPACES}]", f"[^ {_SPACES}]"

# The same characters as a set, for trimming without a regex.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Patterns the results depend on. Digits are those of any script.
IPV4 = r"\b\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}\b"
BLOCK_ID = r"(blk_-?\d+)"
PID_FIELD = r"pid=(\d+)"

# Message cleaning, applied in this order.
CLEAN_RULES = [
    (IPV4, " <IP> "),
    (r"(/[A-Za-z0-9._-]+)+", " <PATH> "),
    (r"\b\p{Nd}{4,}\b", " <NUM> "),
    (r"\buser=[A-Za-z0-9._-]+\b", " user=<USER> "),
    (r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", " <MAC> "),
]

# First masking set, applied in this order.
MASK_RULES_V1 = [
    (IPV4, "<IP>"),
    (r"\b[a-fA-F0-9]{8,}\b", "<ID>"),
    (r"\b(?=[A-Za-z0-9]{8,})(?=.*[A-Za-z])(?=.*\p{Nd})[A-Za-z0-9]+\b", "<ID>"),
    (r"\(\p{Nd}+\)", "(<PID>)"),
    (r"(?i)\b(pid|uid)=\p{Nd}+\b", "$1=<PID>"),
    (r"(?i)\bPID[:=]?\s*\p{Nd}+\b", "PID=<PID>"),
    (r"\b\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}T\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?(?:Z|[+-]\p{Nd}{2}:?\p{Nd}{2})?\b", "<TS>"),
    (r"/[A-Za-z0-9_\-./]+", "<PATH>"),
    (r"[A-Za-z]:\\[^\s]+", "<PATH>"),
]

# Second masking set, applied in this order.
MASK_RULES_V2 = [
    (IPV4, "<IP>"),
    (r"\b(?:0x)?[A-Fa-f0-9]{8,}\b", "<ID>"),
    (r"\b[A-Za-z0-9]{24,}\b", "<ID>"),
    (r"\[(\p{Nd}+)\]", "[<PID>]"),
    (r"\bpid=\p{Nd}+\b", "pid=<PID>"),
    (r"\bpids?\b[:=]?\p{Nd}+\b", "pid=<PID>"),
    (r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}T\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?Z?", "<TS>"),
    (r"\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}", "<TS>"),
    (r"/[A-Za-z0-9_\-./]+", "<PATH>"),
    (r"[A-Za-z]:\\[^ \n\r\t]+", "<PATH>"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    (r"\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b", "<HOST>"),
]

# Tokens that give away the data set, in this order. Digits go
# before node ids, so "node-12" ends as "node-NUM".
IDENTITY_RULES = [
    (r"blk_-?\p{Nd}+", "BLOCK_ID"),
    (r"0x[a-fA-F0-9]+", "HEX_ID"),
    (r"\b\p{Nd}+\b", "NUM"),
    (r"node-\p{Nd}+", "NODE_ID"),
    (r"\b[a-f0-9]{8,}\b", "HASH_ID"),
]

# The JVM's engine recurses once for each turn of a repeated group, and tries a
# failed run again from each of its places. These forms match the same texts
# without either: a run is tried once, from its first word boundary on, and what
# it has before that boundary is kept as group 1.
FLAT_FORMS = {
    r"(/[A-Za-z0-9._-]+)+": r"()(?:/[A-Za-z0-9._-]++)++",
    r"\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b":
        r"(?:\G|(?<![A-Za-z0-9.-])|(?<=\.\.))((?:(?!\b[A-Za-z0-9-])[A-Za-z0-9.-])*+)"
        r"\b[A-Za-z0-9-](?:(?!\.\.)[A-Za-z0-9.-])*\.[A-Za-z]{2,}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b":
        r"(?:\G|(?<![A-Za-z0-9._%+-]))((?:(?!\b)[A-Za-z0-9._%+-])*+)"
        r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}
# What any match of a pattern has in it: plain text, or a class pattern without word boundaries. Most texts have
# few of these, and the search for them costs far less than the pattern's own.
GUARDS = {
    IPV4: r"\p{Nd}\.\p{Nd}",
    r"(/[A-Za-z0-9._-]+)+": "/",
    r"\b\p{Nd}{4,}\b": r"\p{Nd}{4}",
    r"\buser=[A-Za-z0-9._-]+\b": "user=",
    r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b": "[0-9A-Fa-f][:-][0-9A-Fa-f]",
    r"\b[a-fA-F0-9]{8,}\b": "[a-fA-F0-9]{8}",
    r"\(\p{Nd}+\)": r"\(\p{Nd}",
    r"(?i)\b(pid|uid)=\p{Nd}+\b": r"=\p{Nd}",
    r"(?i)\bPID[:=]?\s*\p{Nd}+\b": r"\p{Nd}",
    r"\b\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}T\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?(?:Z|[+-]\p{Nd}{2}:?\p{Nd}{2})?\b": r"\p{Nd}-\p{Nd}",
    r"/[A-Za-z0-9_\-./]+": "/",
    r"[A-Za-z]:\\[^\s]+": ":\\",
    r"\b(?:0x)?[A-Fa-f0-9]{8,}\b": "[A-Fa-f0-9]{8}",
    r"\b[A-Za-z0-9]{24,}\b": "[A-Za-z0-9]{24}",
    r"\[(\p{Nd}+)\]": r"\[\p{Nd}",
    r"\bpid=\p{Nd}+\b": "pid=",
    r"\bpids?\b[:=]?\p{Nd}+\b": "pid",
    r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}T\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?Z?": r"\p{Nd}-\p{Nd}",
    r"\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}": r"\p{Nd}:\p{Nd}",
    r"[A-Za-z]:\\[^ \n\r\t]+": ":\\",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b": "@",
    r"\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b": r"[A-Za-z0-9-]\.[A-Za-z]{2}",
    r"blk_-?\p{Nd}+": "blk_",
    r"0x[a-fA-F0-9]+": "0x",
    r"\b\p{Nd}+\b": r"\p{Nd}",
    r"node-\p{Nd}+": "node-",
    r"\b[a-f0-9]{8,}\b": "[a-f0-9]{8}",
}
LINE_ENDS = "(?<=[\\n\\r\\x85\\u2028\\u2029])"

MESSAGE_LIMIT = 8000
TRUNCATION_MARK = " ...[truncated]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends. A single space is no match, as most are."""
    return F.trim(F.regexp_replace(c, f" {SPACE_CHARS}+|[{_SPACES}]{SPACE_CHARS}*", " "))


def bound(c: Column, of: Callable[[Column], Column]) -> Column:
    """``of(c)`` with ``c`` worked out once, however often ``of`` names it."""
    return F.transform(F.array(c), of)[0]


def _may_match(c: Column, guard: str) -> Column:
    return c.rlike(guard) if any(x in guard for x in "[{\\") and guard != ":\\" else c.contains(guard)


def apply_rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Rules one after another; word boundaries and classes are Unicode's. A rule runs where its guard says it may match."""
    for pattern, replacement in rules:
        flat = FLAT_FORMS.get(pattern)
        c = bound(c, _guarded(GUARDS[pattern], "(?U)" + (flat or pattern), "$1" + replacement if flat else replacement))
    return c


def _guarded(guard: str, form: str, new: str) -> Callable[[Column], Column]:
    return lambda x: F.when(_may_match(x, guard), F.regexp_replace(x, form, new)).otherwise(x)


def mask_mixed_tokens(c: Column, mask: str) -> Column:
    """Mask tokens of eight or more ASCII letters and digits with both a letter and a digit at or after their start in the line.

    Looking ahead from every token reads a line once a token. Here each line is cut behind the word that
    holds its last digit, or its last letter if that comes first: tokens before the cut have both ahead.
    """
    def line(x: Column) -> Column:
        heads = [F.regexp_extract(x, f"(?U)^(.*{last}\\w*)", 1) for last in (r"\p{Nd}", "[A-Za-z]")]
        head = F.when(F.char_length(heads[0]) <= F.char_length(heads[1]), heads[0]).otherwise(heads[1])
        masked = F.regexp_replace(head, r"(?U)\b[A-Za-z0-9]{8,}\b", mask)
        return F.concat(masked, F.substr(x, F.char_length(head) + 1))

    return bound(c, lambda t: F.when(
        t.rlike(r"\p{Nd}"), F.array_join(F.transform(F.split(t, LINE_ENDS), line), "")).otherwise(t))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_message(c: Column) -> Column:
    return collapse(apply_rules(text_or_empty(c), CLEAN_RULES))


def mask_v1(c: Column) -> Column:
    before, (_, mask), after = MASK_RULES_V1[:2], MASK_RULES_V1[2], MASK_RULES_V1[3:]
    return collapse(apply_rules(mask_mixed_tokens(apply_rules(text_or_empty(c), before), mask), after))


def mask_v2(c: Column) -> Column:
    return collapse(apply_rules(text_or_empty(c), MASK_RULES_V2))


def mask_identity(c: Column) -> Column:
    return apply_rules(text_or_empty(c), IDENTITY_RULES)


def fold(c: Column) -> Column:
    """Lower case, single spaces."""
    return collapse(F.lower(c))


def truncate(c: Column, limit: int = MESSAGE_LIMIT) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(TRUNCATION_MARK))).otherwise(c)


def count_chars(c: Column, char_class: str) -> Column:
    return F.regexp_count(c, F.lit(char_class))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda acc, w: acc | c.contains(w), words[1:], c.contains(words[0]))


def count_present(c: Column, words: list[str]) -> Column:
    """How many of the words occur at least once."""
    return reduce(lambda acc, w: acc + c.contains(w).cast("int"), words[1:], c.contains(words[0]).cast("int"))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def vector_like(c: Column) -> Column:
    """Text that is really a dumped number vector: many commas and many digits."""
    size = F.char_length(c)
    commas = size - F.char_length(F.replace(c, F.lit(","), F.lit("")))
    digits = count_chars(c, r"\p{Nd}")
    return (size > 0) & (commas / F.greatest(size, F.lit(1)) > 0.30) & (digits / F.greatest(size, F.lit(1)) > 0.50)


def first_group(c: Column, pattern: str, group: int = 0) -> Column:
    """Matched text, NULL when the pattern does not occur."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def ipv4(c: Column) -> Column:
    return first_group(c, IPV4)


# A zone behind a clock time: Z, an offset of hours or of hours and minutes, or a name.
ZONED = r":\d{2}(?:[.,]\d+)?\s*(?:[+-]\d{1,2}(?::?\d{2}){0,2}|[A-Za-z][A-Za-z0-9_/+:-]*)\s*$"


def utc(c: Column) -> Column:
    """Time of a text: one with a zone is the instant in UTC, one without is taken as it stands; NULL if unreadable."""
    c = F.regexp_replace(c, r"([T ]\d{1,2}:\d{2})(?![:\d])", "$1:00")  # a clock time may lack its seconds
    instant = F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return F.when(c.rlike(ZONED), instant).otherwise(c.try_cast("timestamp_ntz"))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def digest(*cols: Column) -> Column:
    """128-bit key of the joined text; wide enough for trillions of rows."""
    return F.unhex(F.md5(F.concat_ws("|", *cols)))
