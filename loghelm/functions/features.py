"""Numeric features of a message, as column lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loghelm.functions import text

# Feature names in matrix order, words, patterns and caps.
STRUCTURED_20 = [
    "message_length",
    "token_count",
    "digit_ratio",
    "uppercase_ratio",
    "special_char_count",
    "numeric_token_count",
    "unique_token_ratio",
    "contains_ip",
    "contains_url",
    "contains_path",
    "contains_port",
    "contains_hex",
    "error_keyword_count",
    "contains_error",
    "contains_warning",
    "contains_timeout",
    "contains_failure",
    "contains_exception",
    "repeated_token_ratio",
    "average_token_length",
]
ERROR_KEYWORDS = [
    "error",
    "fail",
    "failed",
    "fatal",
    "critical",
    "warning",
    "timeout",
    "denied",
    "exception",
    "panic",
]
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
URL = r"https?://|www\."
PATH = r"[a-zA-Z]:\\|/var/|/home/|/tmp/"
PORT = r"port\s+\d+"
SPECIAL = r"[^a-zA-Z0-9" + text.WS[1:]
# Limits on four counts, applied on request.
CAPS = {"message_length": 10000, "special_char_count": 5000, "token_count": 2000, "numeric_token_count": 1000}
THREE_DIGITS = r"\b\d{3}\b"
EARLY_WORDS = ["block", "packet", "namenode", "replica", "storage"]
LONG_TEXT = 100

TOKEN = text.NON_WS + "+"
# In a text of single spaces: a token that is not digits alone, and the space behind it.
WORDED_TOKEN = r"\p{Nd}*+[^\p{Nd} ][^ ]*+ ?"


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _has(c: Column, word: str) -> Column:
    return c.contains(word).cast("int")


def structured_20(message: Column, caps: dict[str, int] | None = None) -> list[Column]:
    """The full set, from raw or from masked text as the caller chooses; ``caps`` limits counts, by default none.

    Tokens are cut at the single spaces of the collapsed text: to find them by a pattern of all that is not white
    space, the JVM's engine tests every character against some twenty ranges.
    """
    caps = caps or {}
    flat = text.bound(text.text_or_empty(message), lambda body: F.struct(
        body.alias("body"), F.lower(body).alias("low"), text.collapse(body).alias("flat")))
    parts = text.bound(flat, lambda p: F.struct(
        p["body"].alias("body"), p["low"].alias("low"), p["flat"].alias("flat"),
        F.when(p["flat"] == "", F.array().cast("array<string>")).otherwise(F.split(p["flat"], " ")).alias("tokens")))
    every = text.bound(parts, _values_20)
    return [F.least(every[n], F.lit(caps[n])).alias(n) if n in caps else every[n].alias(n) for n in STRUCTURED_20]


def _values_20(parts: Column) -> Column:
    """All of the set from a text, its lower-case form, its form with single spaces and its tokens, each made once."""
    body, low, flat, tokens = parts["body"], parts["low"], parts["flat"], parts["tokens"]
    size, count = F.char_length(body), F.size(tokens)
    counts = text.bound(F.struct(
        size.alias("size"), count.alias("count"), F.size(F.array_distinct(tokens)).alias("distinct"),
        text.count_chars(body, r"\p{Nd}").alias("digits"),
        F.array(*[_has(low, w) for w in ERROR_KEYWORDS]).alias("words")), lambda n: F.struct(
        n["size"].alias("message_length"),
        n["count"].alias("token_count"),
        _ratio(n["digits"], n["size"]).alias("digit_ratio"),
        _ratio(text.count_chars(body, r"\p{Lu}"), n["size"]).alias("uppercase_ratio"),
        F.char_length(F.regexp_replace(flat, "[a-zA-Z0-9 ]++", "")).alias("special_char_count"),
        F.when(n["digits"] > 0, F.regexp_count(F.regexp_replace(flat, WORDED_TOKEN, ""), F.lit(r"\p{Nd}++"))).otherwise(0).alias("numeric_token_count"),
        _ratio(n["distinct"], n["count"]).alias("unique_token_ratio"),
        ((n["digits"] > 3) & body.rlike(IP)).cast("int").alias("contains_ip"),
        body.rlike(URL).cast("int").alias("contains_url"),
        body.rlike(PATH).cast("int").alias("contains_path"),
        ((n["digits"] > 0) & body.rlike(PORT)).cast("int").alias("contains_port"),
        _has(low, "hex_id").alias("contains_hex"),
        reduce(lambda a, i: a + n["words"][i], range(1, len(ERROR_KEYWORDS)), n["words"][0]).alias("error_keyword_count"),
        *[n["words"][ERROR_KEYWORDS.index(w)].alias(f"contains_{w}") for w in ("error", "warning", "timeout")],
        ((n["words"][ERROR_KEYWORDS.index("fail")] > 0) & low.contains("failure")).cast("int").alias("contains_failure"),
        n["words"][ERROR_KEYWORDS.index("exception")].alias("contains_exception"),
        (1 - _ratio(n["distinct"], n["count"])).alias("repeated_token_ratio"),
        _ratio(F.char_length(flat) - F.greatest(n["count"] - 1, F.lit(0)), n["count"]).alias("average_token_length")))
    return counts


def structured_10(message: Column) -> list[Column]:
    body = text.text_or_empty(message)
    low = F.lower(body)
    size = F.char_length(body)
    return [
        size.alias("message_length"),
        _ratio(text.count_chars(body, r"\p{Nd}"), size).alias("digit_ratio"),
        _ratio(text.count_chars(body, r"\p{Lu}"), size).alias("uppercase_ratio"),
        text.count_chars(body, SPECIAL).alias("special_char_count"),
        body.rlike(IP).cast("int").alias("contains_ip"),
        *[_has(low, w).alias(f"contains_{w}") for w in ("failed", "error", "warning", "admin", "login")],
    ]


def structured_9(message: Column, fold_case: bool = False) -> list[Column]:
    """The live set; ``fold_case`` lowers first, which zeroes the upper-case count."""
    body = text.text_or_empty(message)
    body = F.lower(body) if fold_case else body
    return [
        F.char_length(body).alias("length"),
        text.count_chars(body, r"\p{Nd}").alias("digits"),
        text.count_chars(body, r"[^\p{L}\p{N}]").alias("symbols"),
        text.count_chars(body, r"\p{Lu}").alias("uppers"),
        F.regexp_count(body, F.lit(TOKEN)).alias("words"),
        body.rlike(text.IPV4).cast("int").alias("has_ip"),
        _has(body, "error").alias("has_error"),
        _has(body, "warning").alias("has_warning"),
        body.rlike(THREE_DIGITS).cast("int").alias("has_code"),
    ]


def behaviour(message: Column, timestamp: Column) -> list[Column]:
    """Hour, weekday (Monday is 0), digits, slashes, length and the pid in the text."""
    from loghelm.operators.parse import pid_from_message

    body = text.text_or_empty(message)
    return [
        F.coalesce(F.hour(timestamp), F.lit(0)).alias("hour"),
        F.coalesce(F.weekday(timestamp), F.lit(0)).alias("weekday"),
        text.count_chars(body, r"\p{Nd}").alias("digit_count"),
        F.regexp_count(body, F.lit("/")).alias("path_count"),
        F.char_length(body).alias("msg_length"),
        pid_from_message(body).alias("pid"),
    ]


def audit_set(message: Column, timestamp: Column) -> list[Column]:
    low = F.lower(text.text_or_empty(message))
    return [
        F.hour(timestamp).alias("hour"),
        F.weekday(timestamp).alias("weekday"),
        (F.weekday(timestamp) >= 5).cast("int").alias("is_weekend"),
        _has(low, "error").alias("has_error"),
        _has(low, "fail").alias("has_failed"),
        _has(low, "critical").alias("has_critical"),
        text.count_chars(low, r"\p{Nd}").alias("digit_count"),
        F.regexp_count(low, F.lit("/")).alias("path_count"),
    ]


def early_report(message: Column) -> list[Column]:
    """Nine flags of the first report; only their names are published, long_text is ours."""
    body = text.text_or_empty(message)
    low = F.lower(body)
    return [
        F.char_length(body).alias("text_length"),
        F.regexp_count(body, F.lit(TOKEN)).alias("word_count"),
        body.rlike(r"\p{Nd}").cast("int").alias("has_number"),
        _has(low, "block").alias("has_block"),
        (F.char_length(body) > LONG_TEXT).cast("int").alias("long_text"),
        *[_has(low, w).alias(f"has_{w}") for w in EARLY_WORDS[1:]],
    ]
