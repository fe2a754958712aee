"""Parsers of addresses, names, e-mails, phones, identifiers and company names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import NormalizationSettings
from ..functions.dictionary import STATE
from ..functions.normalize import normalize
from ..functions.text import clean, collapse, let, literal_list, literal_map, strip, tokens
from .stages import Stages

ADDRESS_SETTINGS = NormalizationSettings(category="address")
NAME_SETTINGS = NormalizationSettings(expand_abbreviations=False, normalize_numbers=False, category="name")
COMPANY_SETTINGS = NormalizationSettings(category="company")

# The cities that addresses are searched for.
CITIES = [
    "chennai", "mumbai", "delhi", "bengaluru", "bangalore", "hyderabad", "kolkata", "pune", "ahmedabad", "jaipur",
    "surat", "lucknow", "kanpur", "nagpur", "indore", "thane", "bhopal", "visakhapatnam", "vadodara", "firozabad",
    "ludhiana", "rajkot", "agra", "siliguri", "nashik", "faridabad", "patiala", "meerut", "kalyan-dombivli",
    "vasai-virar", "varanasi", "srinagar", "dhanbad", "jodhpur", "amritsar", "raipur", "allahabad", "coimbatore",
    "jabalpur", "gwalior", "vijayawada", "madurai", "guwahati", "chandigarh", "hubli", "dharwad", "mysore", "mysuru",
    "tiruchirappalli", "bareilly", "aligarh", "tiruppur", "gurgaon", "gurugram", "noida", "navi mumbai", "kochi",
    "new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas",
    "san jose", "austin", "jacksonville", "fort worth", "columbus", "charlotte", "san francisco", "indianapolis",
    "seattle", "denver", "washington", "boston", "london", "manchester", "birmingham", "toronto", "vancouver",
    "sydney", "melbourne", "singapore", "dubai",
]
# Titles and suffixes of names.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "shri", "smt", "shree", "rev", "pastor"]
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v", "phd", "md", "esq", "cpa"]
# Patterns of address parts.
POSTAL = r"(?U)\b([0-9]{5,6}(?:-[0-9]{4})?)\b"
UK_POSTAL = r"(?iU)\b([A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2})\b"
HOUSE = r"(?U)\b(?:number\s+)?([0-9]{1,5}[a-z]?(?:[/\-][0-9]{1,5}[a-z]?)?)\b"
STREET = r"(?U)([a-z0-9\s]+?\b(?:road|street|avenue|boulevard|lane|drive|way|court|place|highway|circle)\b)"
LOCALITY = r"(?U)([a-z0-9\s]+?\b(?:nagar|colony|layout|sector|block|enclave|vihar|phase|estate|heights|hills|cross|main)\b(?:\s+(?:east|west|north|south))?)"
# Legal forms, in the order in which the first found counts.
LEGAL_FORMS = [
    r"\bprivate\s+limited\b", r"\bpvt\s+ltd\b", r"\bpublic\s+limited\s+company\b", r"\bplc\b", r"\bllp\b", r"\bllc\b", r"\bltd\b", r"\bco\s+ltd\b",
    r"\bcorp\b", r"\bcorporation\b", r"\binc\b", r"\bincorporated\b", r"\bgmbh\b", r"\bsa\b", r"\bag\b", r"\bcompany\b", r"\bco\b",
]


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def address(st: Stages, value: Column) -> Column:
    """raw, normalized, house_number, street, locality, city, state and postal_code of a clean value.

    A city is the longest known one in the text, and the first by name of those of one length.
    """
    norm = st.normal(value, ADDRESS_SETTINGS)
    postal = F.coalesce(_found(value, POSTAL), F.upper(_found(value, UK_POSTAL)))
    codes = literal_map(STATE)
    by_code = F.get(F.filter(F.transform(tokens(norm), lambda t: F.try_element_at(codes, t)), lambda s: s.isNotNull()), F.lit(0))
    by_name = F.get(F.filter(literal_list(dict.fromkeys(STATE.values())), lambda name: F.contains(norm, name)), F.lit(0))
    known = "|".join(sorted((c for c in CITIES if "-" not in c), key=len, reverse=True))
    cities = F.regexp_extract_all(norm, F.lit(rf"(?U)\b({known})\b"), F.lit(1))
    city = F.get(F.array_sort(F.transform(cities, lambda c: F.struct((-F.char_length(c)).alias("n"), c.alias("c")))), F.lit(0))["c"]
    postal, house, state, city = st.add(postal=postal, house=_found(norm, HOUSE), state=F.coalesce(by_code, by_name), city=city)
    return F.when(value.isNotNull(), F.struct(
        value.alias("raw"), norm.alias("normalized"),
        F.when(postal.isNull() | (house != postal), house).alias("house_number"),
        strip(_found(norm, STREET)).alias("street"), strip(_found(norm, LOCALITY)).alias("locality"),
        city.alias("city"), state.alias("state"), postal.alias("postal_code"),
    ))


def name(st: Stages, value: Column) -> Column:
    """raw, normalized, title, first_name, middle_names, last_name, suffix and initials of a clean value."""
    commas = F.filter(F.transform(F.split(value, ","), strip), lambda p: p != "")
    norm, (parts,) = st.normal(value, NAME_SETTINGS), st.add(parts=commas)
    nothing = F.array().cast("array<string>")
    (words,) = st.add(words=tokens(norm))
    first = F.get(words, F.lit(0))
    titles, suffixes = literal_list(TITLES), literal_list(SUFFIXES)
    titled = F.array_contains(titles, first)
    title = F.when(titled, first)
    (title, words) = st.add(title=title, words=F.when(titled, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words))
    last = F.get(words, F.size(words) - 1)
    ends = (F.size(words) > 0) & F.array_contains(suffixes, last)
    suffix = F.when(ends, last)
    (suffix, words) = st.add(suffix=suffix, words=F.when(ends, F.slice(words, 1, F.size(words) - 1)).otherwise(words))
    (n,) = st.add(n=F.size(words))

    def plain(c):
        return F.filter(tokens(normalize(c, NAME_SETTINGS)), lambda t: ~F.array_contains(literal_list(TITLES + SUFFIXES), t))

    by_comma = F.contains(value, F.lit(",")) & (F.size(parts) >= 2)
    before, after = st.add(
        before=F.when(by_comma, plain(F.get(parts, F.lit(0)))),
        after=F.when(by_comma, plain(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " "))),
    )
    given = F.when(by_comma, F.get(after, F.lit(0))).otherwise(F.get(words, F.lit(0)))
    middle = F.when(by_comma, F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0)))).when(n > 2, F.slice(words, 2, F.greatest(n - 2, F.lit(0)))).otherwise(nothing)
    family = F.when(by_comma, F.nullif(F.array_join(before, " "), F.lit(""))).when(n > 1, F.get(words, n - 1))
    some = n > 0
    given, middle, family = st.add(given=F.when(some, given), middle=F.when(some, middle).otherwise(nothing), family=F.when(some, family))
    named = F.array_compact(F.concat(F.array(given), middle, F.array(family)))
    return F.when(value.isNotNull(), F.struct(
        value.alias("raw"), norm.alias("normalized"), title.alias("title"), given.alias("first_name"), middle.alias("middle_names"),
        family.alias("last_name"), suffix.alias("suffix"), F.transform(named, lambda t: F.substring(t, 1, 1)).alias("initials"),
    ))


def email(value: Column) -> Column:
    """local and domain, parted at the first @; without one all is local."""
    low = F.lower(strip(value))
    return let(low, lambda v: F.struct(
        strip(F.regexp_extract(v, r"(?s)^([^@]*)", 1)).alias("local"),
        strip(F.regexp_extract(v, r"(?s)^[^@]*@(.*)$", 1)).alias("domain"),
    ))


# Fixed value: how an extension is written.
EXTENSION = r"(?iU)\b(?:ext\.?|x)\s*([0-9]+)\b"


def phone(value: Column) -> Column:
    """country_code, national_number and extension; empty where there is none."""
    def parts(s):
        rest = F.regexp_replace(s, EXTENSION, "")
        return F.struct(
            F.regexp_extract(s, EXTENSION, 1).alias("ext"), F.startswith(strip(rest), F.lit("+")).alias("plus"), F.regexp_replace(rest, r"(?U)\D", "").alias("all"))

    def prefixed(s):
        out = F.startswith(s["all"], F.lit("00")) & (F.char_length(s["all"]) > 10)
        return F.struct(s["ext"].alias("ext"), (s["plus"] | out).alias("plus"), s["all"].alias("all"), F.when(out, F.substr(s["all"], F.lit(3))).otherwise(s["all"]).alias("d"))

    def ladder(s):
        d, n = s["d"], F.char_length(s["d"])

        def cut(code):
            return F.struct(F.lit(code).alias("cc"), F.substr(d, F.lit(len(code) + 1)).alias("nat"))

        usa, india, britain = F.startswith(d, F.lit("1")) & (n == 11), F.startswith(d, F.lit("91")) & (n == 12), F.startswith(d, F.lit("44")) & n.isin(12, 13)
        whole = F.struct(F.lit("").alias("cc"), s["all"].alias("nat"))
        tail = F.struct(F.left(d, n - 10).alias("cc"), F.right(d, F.lit(10)).alias("nat"))
        trunk = F.struct(F.lit("").alias("cc"), F.substr(d, F.lit(2)).alias("nat"))
        return F.struct(s["ext"].alias("ext"), F.when(d == "", F.struct(F.lit("").alias("cc"), F.lit("").alias("nat")))
                        .when(s["plus"], F.when(usa, cut("1")).when(india, cut("91")).when(britain, cut("44")).when(n > 10, tail).otherwise(whole))
                        .when(F.startswith(d, F.lit("0")) & (n == 11), trunk).when(india, cut("91")).when(usa, cut("1")).otherwise(whole).alias("p"))

    done = let(let(let(strip(value), parts), prefixed), ladder)
    return let(done, lambda s: F.struct(s["p"]["cc"].alias("country_code"), s["p"]["nat"].alias("national_number"), s["ext"].alias("extension")))


def identifier(value: Column) -> Column:
    """clean, prefix (leading letters) and num (first digits)."""
    return let(F.lower(F.regexp_replace(value, "[^a-zA-Z0-9]", "")), lambda c: F.struct(
        c.alias("clean"), F.regexp_extract(c, "^([a-z]+)", 1).alias("prefix"), F.regexp_extract(c, "([0-9]+)", 1).alias("num")))


def company(st: Stages, value: Column) -> Column:
    """core and suffix: the name without its legal form, and the form as it is written out."""
    norm = st.normal(value, COMPANY_SETTINGS)
    words = tokens(norm)
    (core,) = st.add(core=let(words, lambda t: F.when((F.size(t) > 1) & ~F.exists(t, lambda x: F.char_length(x) != 1), F.array_join(t, "")).otherwise(norm)))
    forms = literal_list("(?iU)" + p for p in LEGAL_FORMS)
    # one look for any of them; which it is only where there is one
    any_form = F.regexp_like(core, F.lit("(?iU)" + "|".join(LEGAL_FORMS)))
    (pattern,) = st.add(form=F.when(any_form, F.get(F.filter(forms, lambda p: F.regexp_like(core, p)), F.lit(0))))
    return F.when(value.isNotNull(), F.struct(
        F.when(pattern.isNull(), core).otherwise(collapse(F.regexp_replace(core, pattern, F.lit("")))).alias("core"),
        F.when(pattern.isNull(), "").otherwise(strip(F.regexp_substr(core, pattern))).alias("suffix"),
    ))


def parse_address(df, column: str, out: str = "address"):
    st = Stages()
    (value,) = st.add(value=clean(F.col(f"`{column}`")))
    return st.done(df, **{out: address(st, value)})


def parse_name(df, column: str, out: str = "name"):
    st = Stages()
    (value,) = st.add(value=clean(F.col(f"`{column}`")))
    return st.done(df, **{out: name(st, value)})


def parse_company(df, column: str, out: str = "company"):
    st = Stages()
    (value,) = st.add(value=clean(F.col(f"`{column}`")))
    return st.done(df, **{out: company(st, value)})
