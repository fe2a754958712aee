"""What a value, a column or a pair of columns holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AUTO
from ..functions.dictionary import ADDRESS, COMPANY
from ..functions.text import clean, let, literal_list, tokens
from .parse import TITLES

# Patterns and words that tell the types.
EMAIL = r"^[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+$"
PHONE = r"(?U)^(?:\+?[0-9]{1,4}[\s\-]?)?(?:\(?\d{2,5}\)?[\s\-]?)?\d{3,5}[\s\-]?\d{3,5}$"
ID_CODE = r"(?i)^[A-Z0-9]{2,}[\-_/][A-Z0-9\-_/]+$|^[A-Z]{1,5}[0-9]{3,12}$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
COMPANY_WORDS = [
    "pvt", "ltd", "private", "limited", "corp", "corporation", "inc", "incorporated", "llc", "llp", "gmbh", "holding", "holdings", "technologies",
    "solutions", "enterprises", "industries", "associates", "group", "bank", "pharma", "motors", "logistics",
]
ADDRESS_WORDS = [
    "road", "rd", "street", "st", "avenue", "ave", "lane", "ln", "nagar", "colony", "sector", "floor", "fl", "flat", "apt", "apartment",
    "building", "bldg", "block", "phase", "cross", "layout", "pin", "zip", "near", "opp", "opposite",
]
HEADER_HINTS = [
    ("email", 0.95, ["email", "e-mail", "mail"]),
    ("phone", 0.95, ["phone", "mobile", "tel", "contact no", "cell"]),
    ("address", 0.95, ["addr", "address", "street", "residence", "location", "billing addr", "shipping addr"]),
    ("company", 0.90, ["company", "organization", "firm", "business", "employer", "vendor"]),
    ("person_name", 0.90, ["name", "full name", "first name", "last name", "customer name", "contact name", "person"]),
    ("id_code", 0.90, ["id", "code", "uuid", "sku", "cust id", "ref", "ssn", "identifier"]),
]
COMPANY_TOKENS = sorted({k for k in COMPANY if k.isalnum()} | set(COMPANY_WORDS))
ADDRESS_TOKENS = sorted({k for k in ADDRESS if k.isalnum()} | set(ADDRESS_WORDS))


def value_type(value: Column) -> Column:
    """The type of one value; the first rule that holds."""
    def told(s):
        v, words, bare = s["v"], s["w"], s["b"]
        digits = F.char_length(F.regexp_replace(v, r"(?U)\D", ""))
        letter, digit, blank = v.rlike("[a-zA-Z]"), v.rlike(r"(?U)\d"), F.contains(v, F.lit(" "))
        n, hits = F.size(words), F.size(F.filter(bare, lambda t: F.array_contains(literal_list(ADDRESS_TOKENS), t)))
        is_phone = ~letter & digits.between(7, 15) & (v.rlike(PHONE) | F.startswith(v, F.lit("+")) | F.contains(v, F.lit("-")) | blank)
        is_id = v.rlike(ID_CODE) | ((F.char_length(v) <= 24) & ~blank & digit & letter)
        titled = (n <= 4) & (F.coalesce(F.array_contains(literal_list(TITLES), F.get(bare, F.lit(0))), F.lit(False)) | (F.contains(v, F.lit(",")) & (n <= 3)))
        two_three = n.between(2, 3) & ~F.exists(words, lambda t: F.char_length(t) < 2)
        return (
            F.when(v == "", "generic_text").when(v.rlike(EMAIL), "email").when(is_phone, "phone").when(is_id, "id_code")
            .when(F.arrays_overlap(bare, literal_list(COMPANY_TOKENS)), "company")
            .when((digit & (hits >= 1)) | (hits >= 2), "address")
            .when(~digit & (titled | two_three), "person_name").otherwise("generic_text")
        )

    words = let(clean(value), lambda v: F.struct(v.alias("v"), tokens(F.lower(v)).alias("w")))
    return let(let(words, lambda s: F.struct(s["v"].alias("v"), s["w"].alias("w"), F.transform(s["w"], lambda t: F.regexp_replace(t, r"(?U)[^\w]", "")).alias("b"))), told)


def pair_type(a: Column, b: Column) -> Column:
    """What both are; if they differ, the first that is not generic text."""
    x, y = value_type(a), value_type(b)
    return let(F.struct(x.alias("x"), y.alias("y")), lambda s: F.when(s["x"] != "generic_text", s["x"]).otherwise(s["y"]))


def header_type(name: str | None) -> tuple[str, float] | None:
    low = (name or "").lower().replace("_", " ").replace("-", " ")
    return next(((kind, sure) for kind, sure, hints in HEADER_HINTS if low and any(h in low for h in hints)), None)


def valid_samples(df: DataFrame, column: str) -> DataFrame:
    """Values that are not null, blank or "nan", as `value`."""
    value = F.col(column).cast("string")
    return df.select(value.alias("value")).where(value.isNotNull() & (clean(value) != "") & (F.lower(value) != "nan"))


def samples_type(samples: DataFrame) -> tuple[str, float]:
    """The most frequent type of the first 50 of `value`, the first seen of equals, and its share."""
    found = samples.limit(50).select(value_type(F.col("value")).alias("kind"), F.monotonically_increasing_id().alias("at"))
    counts = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).orderBy(F.desc("n"), "at").collect()
    if not counts:
        return "generic_text", 0.5
    return counts[0]["kind"], round(counts[0]["n"] / sum(r["n"] for r in counts), 2)


def column_type(df: DataFrame, column: str, header: bool = True) -> tuple[str, float]:
    """A column's type and how sure that is: by its name, else by its first 50 values."""
    return (header_type(column) if header else None) or samples_type(valid_samples(df, column))


def job_type(df: DataFrame, col_a: str, col_b: str, asked: str) -> str:
    """The type for all rows of a job: `auto` and `auto_detect`, so spelt, are settled by 30 values of each column; others stay."""
    if asked not in AUTO[:2]:
        return asked
    by_name = header_type(col_a)
    if by_name:
        return by_name[0]
    heads = [df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("value")).limit(30) for c in (col_a, col_b)]
    return samples_type(valid_samples(heads[0].union(heads[1]), "value"))[0]
