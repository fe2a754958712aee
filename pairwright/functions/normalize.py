"""Text normalisation: one chain of built-in expressions, laid out by plan-time settings."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .dictionary import DELIMITERS, AbbreviationRules
from .text import collapse, let, literal_list, literal_map, strip, strip_accents, tokens

# Words to numbers, in the order of their replacement.
WORD_NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
}
# Number, floor and unit expressions and what they become, in order.
NUMBER_RULES = [
    (r"\b(?:no\.?|num\.?|number|#)\s*([0-9]+[a-z]?)\b", "number $1"),
    (r"#\s*([0-9]+[a-z]?)", "number $1"),
    (r"\b(1st|first)\s+(?:flr|fl\.?|floor)\b", "floor 1"),
    (r"\b(2nd|second)\s+(?:flr|fl\.?|floor)\b", "floor 2"),
    (r"\b(3rd|third)\s+(?:flr|fl\.?|floor)\b", "floor 3"),
    (r"\b([0-9]+)(?:st|nd|rd|th)?\s+(?:flr|fl\.?|floor)\b", "floor $1"),
    (r"\b(?:flr|fl\.?|floor)\s*[:\-#]?\s*([0-9]+)\b", "floor $1"),
    (r"\bf[\-\s]?([0-9]+)\b", "floor $1"),
    (r"\b(?:g[\-\s]?flr|g[\-\s]?fl\.?|ground\s+floor|gf)\b", "ground floor"),
    (r"\b(?:b[\-\s]?flr|b[\-\s]?fl\.?|basement|b1)\b", "basement"),
    (r"\b(?:apt|apartment|flat|ste|suite|unit)\s*[:\-#]?\s*([0-9a-z\-]+)\b", "flat $1"),
]
# Words that the optional stopword step drops.
STOPWORDS = ["the", "and", "or", "in", "on", "at", "to", "for", "of", "with", "a", "an", "by"]
# Fixed value: what the standard mode makes blank.
PUNCTUATION = r"""[.,\-_/\\()\[\]{}:;'"#&~+=?!$*@%|><]"""


#: What a text must hold for any of the rules to change it.
_NUMBER_GATE = "(?i)[0-9#]|fl|gf|basement|apt|apartment|ste|suite|unit|" + "|".join(WORD_NUMBERS)


def number_expressions(c: Column) -> Column:
    """Numbers, floors, units and number words in one way of writing."""
    return let(c, lambda v: F.when(v.rlike(_NUMBER_GATE), _number_rules(v)).otherwise(v))


#: The words as one regex. Their runs of word characters are looked up; none of the numbers they become is a word again.
_NUMBER_WORDS = "(?iU)\\b(?:" + "|".join(WORD_NUMBERS) + ")\\b"


def _number_rules(c: Column) -> Column:
    for i, (pattern, becomes) in enumerate(NUMBER_RULES):
        c = F.regexp_replace(c, ("(?U)" if i == 1 else "(?iU)") + pattern, becomes)
    known = literal_map(WORD_NUMBERS)
    parts = lambda v: F.regexp_extract_all(v, F.lit(r"(?U)\w+|\W+"), F.lit(0))
    looked_up = lambda v: F.array_join(F.transform(parts(v), lambda t: F.coalesce(F.try_element_at(known, F.lower(t)), t)), "")
    return let(c, lambda v: F.when(v.rlike(_NUMBER_WORDS), looked_up(v)).otherwise(v))


def extract_numbers(c: Column) -> Column:
    """All runs of digits that stand alone, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b\d+\b"), F.lit(0))


def _java_literal(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def expand(c: Column, rules: AbbreviationRules | None = None, category: str | None = None) -> Column:
    """Abbreviations written out, by token; without outer white space."""
    phrases, by_token = (rules or AbbreviationRules()).compiled(category)
    if not phrases and not by_token:
        return F.coalesce(c, F.lit(""))
    c = F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))
    for key, expansion in phrases:
        escaped = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", key)
        dot = "" if key.endswith(".") else r"\.?"
        c = F.regexp_replace(c, rf"(?i)(?<=[{DELIMITERS}]){escaped}{dot}(?=[{DELIMITERS}])", _java_literal(expansion))
    if by_token:
        known = literal_map(by_token)
        parts = F.regexp_extract_all(c, F.lit(rf"(?U)([^{DELIMITERS}]+|[{DELIMITERS}])"), F.lit(1))
        c = F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(known, F.lower(t)), t)), "")
    return strip(c)


def normalize(c: Column, settings=None) -> Column:
    """A value in normal form; null and blank are empty. Each step uses the one before once."""
    if settings is None:
        from ..config import NormalizationSettings

        settings = NormalizationSettings()
    mode = settings.mode.lower()
    c = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+$", "")
    if settings.remove_accents:
        c = strip_accents(c)
    if not settings.case_sensitive:
        c = F.lower(c)
    if mode == "conservative":
        return collapse(c) if settings.normalize_whitespace else c
    if settings.normalize_numbers:
        c = number_expressions(c)
    if settings.expand_abbreviations:
        c = expand(c, settings.rules, settings.category)
    if mode == "aggressive":
        c = F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s]", " ")
    elif settings.remove_punctuation:
        c = F.regexp_replace(c, PUNCTUATION, " ")
    if settings.normalize_whitespace:
        c = collapse(c)
    if settings.remove_stopwords:
        c = F.array_join(F.filter(tokens(c), lambda t: ~F.array_contains(literal_list(STOPWORDS), t)), " ")
    return c


def tokenize(c: Column, settings=None) -> Column:
    return tokens(normalize(c, settings))
