"""Helpers that spell the SQL twins."""

from __future__ import annotations

from loghelm.functions import text


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replaced(sql: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return sql


def stripped(sql: str) -> str:
    return f"regexp_replace({sql}, '^{text.WS}+|{text.WS}+$', '', 'g')"


def collapsed(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{text.WS}+', ' ', 'g'))"


def counted(sql: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({sql}, {quoted(pattern)})) AS INT)"


def any_of(sql: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({sql}, {quoted(w)})" for w in words) + ")"


def iso(sql: str) -> str:
    return f"strftime({sql}, '%Y-%m-%dT%H:%M:%SZ')"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"
