"""Unicode-aware string helpers as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def literal_list(values) -> Column:
    """Texts as one constant, which Spark folds when it plans; made with two calls however many there are."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def literal_map(values: dict[str, str]) -> Column:
    return F.map_from_arrays(literal_list(values), literal_list(values.values()))


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """A value as text without outer white space; null is empty."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def is_empty(c: Column) -> Column:
    return c == ""


def _plain(text: str) -> str:
    """Decomposed for compatibility, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


#: Hangul syllables decompose by a rule: so many vowels and endings for each of the leading consonants.
_HANGUL, _VOWELS, _ENDINGS = 0xAC00, 21, 28


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str, str, list[str]]:
    """From all of Unicode: characters with one plain character, and marks that go; those plain ones; characters with several, and these.

    A text's decomposition is that of its characters: only marks change places, and marks go.
    """
    kept, bases, gone, many, expanded = [], [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or _HANGUL <= code < _HANGUL + 11172:
            continue
        c = chr(code)
        plain = _plain(c)
        if plain == c:
            continue
        if not plain:
            gone.append(c)
        elif len(plain) == 1:
            kept.append(c)
            bases.append(plain)
        else:
            many.append(c)
            expanded.append(plain)
    return "".join(kept + gone), "".join(bases), "".join(many), expanded


@lru_cache(maxsize=1)
def _several() -> str:
    """A regex for the characters with several plain ones."""
    codes, spans = sorted(map(ord, accent_tables()[2])), []
    for code in codes:
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[\uac00-\ud7a3" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def _expanded(ch: Column) -> Column:
    """The plain characters of one that has several, or itself."""
    _, _, many, expanded = accent_tables()
    at, code = F.instr(F.lit(many), ch), F.ascii(ch) - _HANGUL
    per = _VOWELS * _ENDINGS

    def letter(first: int, n: int, which: Column) -> Column:
        return F.get(literal_list(chr(first + k) if first + k != 0x11A7 else "" for k in range(n)), which)

    hangul = F.concat(letter(0x1100, 19, F.floor(code / per).cast("int")), letter(0x1161, _VOWELS, F.floor(code % per / _ENDINGS).cast("int")), letter(0x11A7, _ENDINGS, (code % _ENDINGS).cast("int")))
    return F.when(code.between(0, 11171), hangul).when(at > 0, F.get(literal_list(expanded), at - 1)).otherwise(ch)


def strip_accents(c: Column) -> Column:
    """Characters in their plain form, by Unicode's compatibility decomposition and without combining marks.

    ASCII values are left as they are; of the others, those that hold a ligature, fraction, syllable or the like are taken apart by
    character first; the rest is one character for one.
    """
    source, bases, _, _ = accent_tables()
    apart = lambda v: F.array_join(F.transform(F.split(v, ""), _expanded), "")
    return let(c, lambda v: F.when(F.octet_length(v) == F.char_length(v), v).otherwise(F.translate(F.when(v.rlike(_several()), apart(v)).otherwise(v), source, bases)))
