"""License scan: ordered signature rules over the words of a text, in DataFrame functions only.

A text's words are tagged with their places ("mit\u0001 17"-like tokens), so that a match of a
rule carries its first and last word and no prefix sums are needed. Rules are gated by
keywords, a text by the keywords of all rules; a detection that lies within another of at least its priority is suppressed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .license_rules import GROUPS
from .storage import count_pieces, without

#: What parts the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of an A-Z-lowered text, before lowering or after.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """pattern: a regex over words parted by one space; keyword: words, the last of them perhaps cut, that every match
    holds; where alternatives of the pattern share none, one for each, parted by |."""

    label: str
    keyword: str
    pattern: str
    priority: int  # 1 to 3
    weight: float
    base: bool = False


#: Contract phrases (fixed values); they are labelled wherever they stand.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]


def default_rules() -> list[Rule]:
    """The rules in order: base phrases, then the signatures by group."""
    return [Rule(label, words, words, 1, 0.6, True) for label, words in BASE] + [Rule(*x) for group in GROUPS for x in group]


def _tagged(pattern: str) -> str:
    """The rule's regex for text in which each word is followed by \\x01 and its place."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(" ?", i):
            out.append("(?:\x01[0-9]+ )?")
            i += 2
        elif pattern[i] == " ":
            out.append("\x01[0-9]+ ")
            i += 1
        elif pattern[i] == ".":
            out.append("[^\\n]")
            i += 1
        else:
            out.append(pattern[i])
            i += 1
    return "(?<![^ ])(?:" + "".join(out) + ")\x01[0-9]+"


def _keywords(rules: list[Rule]) -> list[str]:
    """The rules' keywords, each once."""
    return sorted({k for r in rules for k in r.keyword.split("|")})


#: Words that stand in much prose of other kinds; they gate nothing by themselves.
COMMON = {
    "available", "control", "document", "event", "freedom", "general", "government", "library", "network", "other", "personal", "project", "public", "purposes",
    "received", "restriction", "shall", "should", "software", "source", "special", "subject", "terms", "third", "under", "united", "university", "useful", "version", "without", "young",
}


def gate_tokens(rules: list[Rule]) -> tuple[set[str], set[str], list[list[str]]] | None:
    """What a text's words must begin with to have a match of any rule, made of the rules' keywords; None if a rule has none.

    One of the first, by its first five characters; or one of the second, by three; or all of one of the last, by five.
    A keyword is stood for by one word that is neither short nor common, and else by all its words; of its last word, which may be cut,
    by no more than it gives.
    """
    single: set[str] = set()
    short: set[str] = set()
    together: list[list[str]] = []
    for key in sorted(_keywords(rules), key=lambda k: (k.count(" "), len(k), k)):
        *whole, last = key.split() or [""]
        fit = [w[:5] for w in [*whole, last] if len(w) >= 5 and w not in COMMON]
        if fit:
            single.add(next((w for w in fit if w in single), max(fit, key=len)))
        elif whole:
            together.append(sorted({w[:5] for w in whole} | ({last[:5]} if len(last) >= 5 else set())))
        elif len(last) >= 3:
            short.add(last[:3])
        else:
            return None
    return single, short, together


def _gate(pieces: Column, rules: list[Rule]) -> Column:
    """Whether a text, lower-cased and split into its words, may hold a keyword of the rules: look-ups of its words' beginnings."""
    tokens = gate_tokens(rules)
    if tokens is None:
        return F.lit(True)
    single, short, together = tokens
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    begins = lambda n: F.transform(pieces, lambda w: F.substring(w, 1, n))

    def all_of_one(of):
        held = F.array_intersect(constant(sorted({w for k in together for w in k}), "array<string>"), of)
        return F.transform(F.array(held), lambda h: F.exists(constant(together, "array<array<string>>"), lambda k: F.size(F.array_except(k, h)) == 0))[0]

    by_five = F.transform(F.array(begins(5)), lambda of: F.arrays_overlap(of, constant(sorted(single), "array<string>")) | all_of_one(of))[0]
    return F.arrays_overlap(begins(3), constant(sorted(short), "array<string>")) | by_five


def _token(key: str) -> str:
    """The beginning, five characters at most, of one of the keyword's words; empty if its only word may be cut within these."""
    *whole, last = key.split() or [""]
    return max([w[:5] for w in whole] + [last[:5]] * (len(last) >= 5), key=len, default="")


def _literal(rules: list[Rule]) -> Column:
    """The rules, by keywords, as one constant, which Spark folds when it plans."""
    groups: dict[str, list[dict]] = {}
    for r in rules:
        groups.setdefault(r.keyword, []).append({"pattern": _tagged(r.pattern), "label": r.label, "priority": r.priority, "weight": r.weight, "base": r.base})
    rows = [{"keywords": [{"text": " " + k, "token": _token(k)} for k in keyword.split("|")], "rules": of} for keyword, of in groups.items()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<keywords:array<struct<text:string,token:string>>,rules:array<struct<pattern:string,label:string,priority:int,weight:double,base:boolean>>>>")


def _found(rules: list[Rule], plain: str, tagged: str, words: str) -> Column:
    """All detections of the rules of which the text holds a keyword, by first word, longest first.

    Which words of keywords a text has is looked up first, and a keyword is searched for only if its word is there. The
    forms of the text are bound once: named in a lambda, they would be made anew for every rule.
    """
    groups = _literal(rules)
    tokens = F.from_json(F.lit(json.dumps(sorted({_token(k) for k in _keywords(rules)} - {""}))), "array<string>")
    present = F.concat(F.array(F.lit("")), F.array_intersect(tokens, F.transform(F.col(words), lambda w: F.substring(w, 1, 5))))

    def of(text, r):
        return F.transform(
            F.regexp_extract_all(text, r["pattern"], F.lit(0)),
            lambda m: F.struct(
                F.regexp_extract(m, "\x01([0-9]+)", 1).cast("int").alias("first"),
                (-F.substring_index(m, "\x01", -1).cast("int")).alias("neg_last"),
                (-r["priority"]).alias("neg_priority"),
                r["label"].alias("label"),
                r["weight"].alias("weight"),
                r["base"].alias("base"),
            ),
        )

    def all_of(t):
        held = F.filter(groups, lambda g: F.exists(g["keywords"], lambda k: F.array_contains(t["present"], k["token"]) & F.contains(t["plain"], k["text"])))
        return F.array_sort(F.flatten(F.transform(F.flatten(F.transform(held, lambda g: g["rules"])), lambda r: of(t["tagged"], r))))

    return F.transform(F.array(F.struct(F.col(plain).alias("plain"), F.col(tagged).alias("tagged"), present.alias("present"))), all_of)[0]


def _kept(found: str) -> Column:
    """Fold over sorted detections; reachN is the last word so far of a detection of priority N.

    A detection stands within an earlier one of its priority or more if that one's reach is
    not below its last word. The state is of fixed size but for the distinct labels.
    """
    start = F.struct(
        F.lit(-1).alias("reach1"), F.lit(-1).alias("reach2"), F.lit(-1).alias("reach3"),
        F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"), F.lit(0.0).alias("score"),
    )

    def step(acc, d):
        last, priority = -d["neg_last"], -d["neg_priority"]
        covering = F.greatest(
            acc["reach3"],
            F.when(priority <= 2, acc["reach2"]).otherwise(-1),
            F.when(priority <= 1, acc["reach1"]).otherwise(-1),
        )
        out = covering >= last
        reach = [F.when(priority == p, F.greatest(acc[f"reach{p}"], last)).otherwise(acc[f"reach{p}"]).alias(f"reach{p}") for p in (1, 2, 3)]
        labels = F.when(out | F.array_contains(acc["labels"], d["label"]), acc["labels"]).otherwise(F.concat(acc["labels"], F.array(d["label"])))
        return F.struct(
            *reach, labels.alias("labels"), (acc["n"] + F.when(out, 0).otherwise(1)).alias("n"),
            F.when(out, acc["score"]).otherwise(F.greatest(acc["score"], d["weight"])).alias("score"),
        )

    return F.aggregate(F.col(found), start, step)


ADDED = ["n_words", "detections", "n_base", "first_word", "last_word", "base_labels", "license_labels", "n_kept", "license_score"]


def scan(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """df with n_words, detections, the base phrases' places, labels, n_kept and license_score.

    detections: all of them as structs of first and last word, label, priority, weight, base.
    Null and empty texts have no words, no detections and score 0. Input columns named like
    an added one are replaced. Each row is worked on by itself: no shuffle, so neither copies nor hot
    sources matter, and a text's work grows with its own length.
    """
    rules = default_rules() if rules is None else rules
    df = without(df, [*ADDED, "_pieces", "_gate", "_words", "_plain", "_tagged", "_found", "_kept", "_base"])
    own = [F.col(f"`{c}`") for c in df.columns]
    text = F.col(f"`{text_col}`")
    words = F.when(F.col("_gate"), F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != ""))
    step = df.select(*own, F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN).alias("_pieces"))
    step = step.select(*own, count_pieces(F.col("_pieces")).alias("n_words"), _gate(F.col("_pieces"), rules).alias("_gate"))
    step = step.withColumn("_words", words)
    step = step.withColumn("_plain", F.concat(F.lit(" "), F.array_join("_words", " "))).withColumn(
        "_tagged", F.array_join(F.transform("_words", lambda w, i: F.concat(w, F.lit("\x01"), i.cast("string"))), " ")
    )
    step = step.withColumn("_found", F.when(F.col("_gate"), _found(rules, "_plain", "_tagged", "_words")).otherwise(F.array()))
    step = step.withColumn("_kept", _kept("_found")).withColumn("_base", F.filter("_found", lambda d: d["base"]))
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda d: d["label"])))
    return step.select(
        *own,
        "n_words",
        F.transform("_found", lambda d: F.struct(
            d["first"].alias("first"), (-d["neg_last"]).alias("last"), d["label"].alias("label"), (-d["neg_priority"]).alias("priority"), d["weight"].alias("weight"), d["base"].alias("base"))).alias("detections"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda d: d["first"])).cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        F.array_sort(F.array_union(base_labels, F.col("_kept.labels"))).alias("license_labels"),
        F.col("_kept.n").cast("long").alias("n_kept"),
        F.col("_kept.score").alias("license_score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of scan() over documents."""
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("license_labels", ",").alias("labels"),
        F.col("license_score").alias("score"),
        "n_kept",
    )
