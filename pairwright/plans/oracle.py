"""The queries again as DuckDB SQL, written from the definitions, for the driver's comparison."""

from __future__ import annotations

from ..config import WEIGHT_PROFILES
from ..functions.dictionary import STATE, AbbreviationRules
from ..functions.normalize import NUMBER_RULES, STOPWORDS, WORD_NUMBERS
from ..operators import detect, parse
from .pairs import PAIRS


def text(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


class Sql:
    """A query that grows by computed columns."""

    def __init__(self, base: str):
        self.query = base

    def add(self, **columns: str) -> Sql:
        self.query = "select *, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + f" from ({self.query})"
        return self

    def select(self, columns: str, rest: str = "") -> str:
        return f"select {columns} from ({self.query}) {rest}"


def of(pair_set: str) -> Sql:
    return Sql(PAIRS[pair_set])


# ---- measures ----

def guarded(a: str, b: str, score: str) -> str:
    return f"(case when {a} is null or {b} is null then 0.0::double when {a} = {b} then 100.0::double when {a} = '' or {b} = '' then 0.0::double else {score} end)"


def exact(a: str, b: str) -> str:
    return f"(case when {a} = {b} then 100.0::double else 0.0::double end)"


def lev(a: str, b: str) -> str:
    return guarded(a, b, f"(1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))) * 100.0::double")


def toks(a: str) -> str:
    return rf"list_filter(string_split_regex({a}, '\s+'), lambda t_: t_ <> '')"


def joined(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ' ')"


def sort_ratio(q: Sql, name: str, a: str, b: str) -> Sql:
    q.add(**{f"{name}_x": joined(toks(a)), f"{name}_y": joined(toks(b))})
    return q.add(**{name: guarded(a, b, lev(f"{name}_x", f"{name}_y"))})


def set_ratio(q: Sql, name: str, a: str, b: str) -> Sql:
    x, y, i, p, r = (f"{name}_{k}" for k in "xyipr")
    q.add(**{x: f"list_distinct({toks(a)})", y: f"list_distinct({toks(b)})"})
    q.add(**{i: joined(f"list_filter({x}, lambda t_: list_contains({y}, t_))"),
             p: joined(f"list_filter({x}, lambda t_: not list_contains({y}, t_))"), r: joined(f"list_filter({y}, lambda t_: not list_contains({x}, t_))")})
    q.add(**{f"{name}_s": f"trim({i} || ' ' || {p})", f"{name}_t": f"trim({i} || ' ' || {r})"})
    s, t = f"{name}_s", f"{name}_t"
    none = f"case when {i} = '' then 0.0::double else "
    return q.add(**{name: guarded(a, b, f"greatest({none}{lev(i, s)} end, {none}{lev(i, t)} end, {lev(s, t)})")})


def jaccard(q: Sql, name: str, a: str, b: str) -> Sql:
    x, y = f"{name}_x", f"{name}_y"
    q.add(**{x: f"list_distinct({toks(a)})", y: f"list_distinct({toks(b)})"})
    both = f"len(list_filter({x}, lambda t_: list_contains({y}, t_)))"
    return q.add(**{name: f"case when len({x}) = 0 and len({y}) = 0 then 100.0::double else {both}::double / (len({x}) + len({y}) - {both}) * 100.0::double end"})


def partial(q: Sql, name: str, a: str, b: str) -> Sql:
    s, l = f"{name}_s", f"{name}_l"
    q.add(**{s: f"case when length({a}) <= length({b}) then {a} else {b} end", l: f"case when length({a}) <= length({b}) then {b} else {a} end"})
    window = f"list_max(list_transform(range(1, length({l}) - length({s}) + 2), lambda i_: (1 - levenshtein({s}, substr({l}, i_::int, length({s})::int))::double / length({s})) * 100.0::double))"
    return q.add(**{name: guarded(a, b, f"case when contains({l}, {s}) then 100.0::double else {window} end")})


def ngram(q: Sql, name: str, a: str, b: str) -> Sql:
    x, y = f"{name}_x", f"{name}_y"

    def grams(c):
        p = f"('^' || {c} || '$')"
        return f"case when length({p}) < 3 then [{p}] else list_distinct(list_transform(range(1, length({p}) - 1), lambda i_: substr({p}, i_::int, 3))) end"

    q.add(**{x: grams(a), y: grams(b)})
    return q.add(**{name: guarded(a, b, f"2.0::double * len(list_filter({x}, lambda t_: list_contains({y}, t_))) / (len({x}) + len({y})) * 100.0::double")})


def jaro(q: Sql, name: str, a: str, b: str, winkler: bool = False) -> Sql:
    """Greedy matching as a fold: the state is b with its matched characters marked, a bar, and a's matched characters."""
    n = {k: f"{name}_{k}" for k in ("a", "b", "d", "st", "r", "ma", "mb", "m", "j")}
    q.add(**{n["a"]: f"coalesce({a}, '')", n["b"]: f"coalesce({b}, '')"})
    q.add(**{n["d"]: f"greatest(greatest(length({n['a']}), length({n['b']})) // 2 - 1, 0)"})
    lo, ch = f"greatest(1, i_::bigint - {n['d']})", f"substr({n['a']}, i_::bigint, 1)"
    width = f"least(length({n['b']}), i_::bigint + {n['d']}) - {lo} + 1"
    at = f"(case when {width} > 0 then strpos(substr(s_, {lo}, {width}), {ch}) else 0 end)"
    step = f"case when {at} > 0 then substr(s_, 1, {lo} + {at} - 2) || chr(1) || substr(s_, {lo} + {at}) || {ch} else s_ end"
    q.add(**{n["st"]: f"list_reduce(list_transform(range(1, length({n['a']}) + 1), lambda k_: k_::varchar), lambda s_, i_: {step}, {n['b']} || chr(2))"})
    q.add(**{n["r"]: f"substr({n['st']}, 1, length({n['b']}))", n["ma"]: f"substr({n['st']}, length({n['b']}) + 2)"})
    q.add(**{n["mb"]: f"array_to_string(list_transform(list_filter(range(1, length({n['b']}) + 1), lambda k_: substr({n['r']}, k_, 1) = chr(1)), lambda k_: substr({n['b']}, k_, 1)), '')", n["m"]: f"length({n['ma']})"})
    swaps = f"len(list_filter(range(1, {n['m']} + 1), lambda k_: substr({n['ma']}, k_, 1) <> substr({n['mb']}, k_, 1)))"
    q.add(**{n["j"]: f"case when {n['m']} = 0 then 0.0::double else ({n['m']}::double / length({n['a']}) + {n['m']}::double / length({n['b']}) + ({n['m']} - {swaps} / 2.0::double) / {n['m']}) / 3.0::double end"})
    score = f"{n['j']}"
    if winkler:
        prefix = "(" + " + ".join(f"case when length({n['a']}) >= {k} and length({n['b']}) >= {k} and substr({n['a']}, 1, {k}) = substr({n['b']}, 1, {k}) then 1 else 0 end" for k in (1, 2, 3, 4)) + ")"
        score = f"least(1.0::double, {score} + {prefix} * 0.1::double * (1.0::double - {score}))"
    return q.add(**{name: guarded(a, b, f"{score} * 100.0::double")})


def jaro_winkler(q: Sql, name: str, a: str, b: str) -> Sql:
    return jaro(q, name, a, b, True)


def osa(q: Sql, name: str, a: str, b: str) -> Sql:
    """The edit table as a fold over a's characters: the state is the last two rows, a character of code 33 + n for each number n."""
    width = f"(length({b}) + 1)"
    first = f"array_to_string(list_transform(range(0, length({b}) + 1), lambda k_: chr((33 + k_)::int)), '')"
    before, last = f"substr(s_, 1, {width})", f"substr(s_, {width} + 1, {width})"
    i, j = "i_::bigint", "j_::bigint"
    n = lambda text_, at: f"(unicode(substr({text_}, {at}, 1)) - 33)"
    at = lambda c, k: f"substr({c}, {k}, 1)"
    swap = f"case when {i} > 1 and {j} > 1 and {at(a, i)} = {at(b, j + ' - 1')} and {at(a, i + ' - 1')} = {at(b, j)} then {n(before, j + ' - 1')} + 1 else 1000 end"
    cell = f"least({n(last, j + ' + 1')} + 1, unicode(right(r_, 1)) - 33 + 1, {n(last, j)} + case when {at(a, i)} = {at(b, j)} then 0 else 1 end, {swap})"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda k_: k_::varchar), lambda r_, j_: r_ || chr((33 + {cell})::int), chr((33 + {i})::int))"
    q.add(**{f"{name}_s": f"list_reduce(list_transform(range(1, length({a}) + 1), lambda k_: k_::varchar), lambda s_, i_: {last} || {row}, {first} || {first})"})
    return q.add(**{name: guarded(a, b, f"(1 - (unicode(right({name}_s, 1)) - 33)::double / greatest(length({a}), length({b}))) * 100.0::double")})


# ---- normal form ----

#: Characters of the accents' pairs that are more than a base with marks, and their plain forms.
PLAIN = {
    "\u0439": "\u0438", "\u0451": "\u0435", "\u03ac": "\u03b1", "\u0390": "\u03b9", "\ufb01": "fi", "\ufb03": "ffi", "\u00bd": "1\u20442", "\u0133": "ij", "\uff21": "A", "\u339e": "km",
    "\ud55c": "\u1112\u1161\u11ab", "\u0301": "", "\u0308": "", "\u00e9": "e", "\u00f6": "o", "\u00c5": "A", "\u00b2": "2",
}


def accents(c: str) -> str:
    for source, plain in PLAIN.items():
        c = f"replace({c}, {text(source)}, {text(plain)})"
    return c


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def collapse(c: str) -> str:
    return strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


def clean(c: str) -> str:
    return strip(f"coalesce({c}, '')")


def numbers(c: str) -> str:
    for i, (pattern, becomes) in enumerate(NUMBER_RULES):
        flag = "" if i == 1 else "(?i)"
        c = f"regexp_replace({c}, {text(flag + pattern)}, {text(becomes.replace('$1', chr(92) + '1'))}, 'g')"
    for word, number in WORD_NUMBERS.items():
        c = rf"regexp_replace({c}, '(?i)\b{word}\b', '{number}', 'g')"
    return c


def expand(c: str, category: str | None = None, rules: AbbreviationRules | None = None) -> str:
    merged = (rules or AbbreviationRules()).merged(category)
    dotted = {k + ".": v for k, v in merged.items() if not k.endswith(".")}
    known = {**dotted, **merged}
    phrases = sorted((k for k in merged if " " in k), key=len, reverse=True)
    c = f"' ' || {c} || ' '"
    for k in phrases:  # a phrase's neighbours are kept, as this engine cannot look around
        escaped = k.replace(".", r"\.")
        c = rf"regexp_replace({c}, '(?i)([\s,;/\-()\[\]{{}}:]){escaped}\.?([\s,;/\-()\[\]{{}}:])', '\1{merged[k]}\2', 'g')"
    single = {k: v for k, v in known.items() if " " not in k}
    table = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in sorted(single.items())) + "}"
    parts = rf"regexp_extract_all({c}, '([^\s,;/\-()\[\]{{}}:]+|[\s,;/\-()\[\]{{}}:])', 1)"
    return strip(f"array_to_string(list_transform({parts}, lambda w_: coalesce({table}[lower(w_)], w_)), '')")


def normal(c: str, mode: str = "standard", category: str | None = None, with_numbers: bool = True, with_expansion: bool = True) -> str:
    c = f"lower(coalesce({c}, ''))"
    if mode == "conservative":
        return collapse(c)
    if with_numbers:
        c = numbers(c)
    if with_expansion:
        c = expand(c, category)
    if mode == "aggressive":
        c = rf"regexp_replace({c}, '[^a-zA-Z0-9\s]', ' ', 'g')"
    else:
        c = rf"""regexp_replace({c}, '[.,\-_/\\()\[\]{{}}:;''"#&~+=?!$*@%|><]', ' ', 'g')"""
    return collapse(c)


# ---- scores ----

def composite(components: dict[str, str], weights: dict[str, float]) -> str:
    used = [(components[k], w) for k, w in weights.items() if k in components and w > 0]
    total = repr(sum(w / 100.0 for _, w in used))
    return "greatest(0.0::double, least(100.0::double, (" + " + ".join(f"{c} * {w / 100.0!r}::double" for c, w in used) + f") / {total}::double))"


def status(score: str, t=(85.0, 70.0, 40.0, 20.0)) -> str:
    return f"(case when {score} >= {t[0]} then 'Strong Match' when {score} >= {t[1]} then 'Likely Match' when {score} >= {t[2]} then 'Possible Match' when {score} >= {t[3]} then 'Weak Match' else 'No Match' end)"


def confidence(score: str, components: list[str]) -> str:
    high, low = (f"{f}({', '.join(components)})" for f in ("greatest", "least"))
    return (f"(case when {score} >= 88 then case when {high} - {low} <= 25 then 'High' else 'Medium' end when {score} <= 20 then case when {high} <= 35 then 'High' else 'Medium' end "
            f"when {score} >= 60 then 'Medium' else case when {high} - {low} >= 40 then 'Low' else 'Medium' end end)")


def default_summary(score: str, shared: str) -> str:
    return (f"(case when {score} >= 90 then 'High similarity across components with ' || {shared}::varchar || ' shared tokens.' when {score} >= 70 then 'Likely match with minor differences in wording or formatting.' "
            f"when {score} >= 45 then 'Partial overlap detected; verify specific attributes.' else 'Low similarity; strings differ significantly.' end)")


def scored(q: Sql, kind: str, components: dict[str, str], na: str, nb: str, said: str = "''", weights: dict[str, float] | None = None, thresholds=(85.0, 70.0, 40.0, 20.0)) -> Sql:
    """Adds score_raw, score, status, confidence, matching_type, token columns and summary."""
    q.add(score_raw=composite(components, weights or WEIGHT_PROFILES[kind]), ta_=f"list_distinct({toks(na)})", tb_=f"list_distinct({toks(nb)})", said_=said)
    q.add(shared_="list_filter(ta_, lambda t_: list_contains(tb_, t_))", normalized_a=na, normalized_b=nb)
    return q.add(
        score="round(score_raw, 1)", status=status("score_raw", thresholds), confidence=confidence("score_raw", list(components.values())), matching_type=text(kind),
        matching_tokens=joined("shared_"), only_a=joined("list_filter(ta_, lambda t_: not list_contains(tb_, t_))"), only_b=joined("list_filter(tb_, lambda t_: not list_contains(ta_, t_))"),
        summary=f"case when said_ <> '' then said_ else {default_summary('score_raw', 'len(shared_)')} end")


def id_parts(q: Sql, side: str) -> Sql:
    q.add(**{f"k{side}": f"lower(regexp_replace({side}, '[^a-zA-Z0-9]', '', 'g'))"})
    return q.add(**{f"p{side}": f"regexp_extract(k{side}, '^([a-z]+)', 1)", f"n{side}": f"regexp_extract(k{side}, '([0-9]+)', 1)"})


def match_id(q: Sql, weights=None, thresholds=(85.0, 70.0, 40.0, 20.0)) -> Sql:
    id_parts(id_parts(q, "a"), "b")
    q.add(c_exact="case when ka = kb and ka <> '' then 100.0::double else 0.0::double end",
          c_prefix=f"case when pa <> '' and pb <> '' then {exact('pa', 'pb')} when pa = '' and pb = '' then 100.0::double else 50.0::double end", c_lev=lev("ka", "kb"))
    said = "case when c_exact = 100 then 'Exact identifier match (' || upper(ka) || ')' when c_prefix = 100 and pa <> '' then 'Matching prefix ''' || upper(pa) || '''' else '' end"
    return scored(q, "id_code", {"exact_clean": "c_exact", "prefix_match": "c_prefix", "levenshtein": "c_lev"}, "ka", "kb", said, weights, thresholds)


def phone_parts(q: Sql, side: str) -> Sql:
    ext = r"(?i)\b(?:ext\.?|x)\s*([0-9]+)\b"
    n = {k: f"{k}{side}" for k in ("ext", "rest", "all", "plus", "d", "cc", "nat")}
    q.add(**{n["ext"]: f"regexp_extract({side}, {text(ext)}, 1)", n["rest"]: f"regexp_replace({side}, {text(ext)}, '', 'g')"})
    q.add(**{n["all"]: rf"regexp_replace({n['rest']}, '\D', '', 'g')"})
    out = f"(starts_with({n['all']}, '00') and length({n['all']}) > 10)"
    q.add(**{n["plus"]: f"starts_with(trim({n['rest']}), '+') or {out}", n["d"]: f"case when {out} then substr({n['all']}, 3) else {n['all']} end"})
    d, l = n["d"], f"length({n['d']})"
    usa, india, uk = f"(starts_with({d}, '1') and {l} = 11)", f"(starts_with({d}, '91') and {l} = 12)", f"(starts_with({d}, '44') and {l} in (12, 13))"
    cc = f"case when {d} = '' then '' when {n['plus']} then case when {usa} then '1' when {india} then '91' when {uk} then '44' when {l} > 10 then left({d}, {l} - 10) else '' end when starts_with({d}, '0') and {l} = 11 then '' when {india} then '91' when {usa} then '1' else '' end"
    nat = f"case when {d} = '' then '' when {n['plus']} then case when {usa} then substr({d}, 2) when {india} or {uk} then substr({d}, 3) when {l} > 10 then right({d}, 10) else {n['all']} end when (starts_with({d}, '0') and {l} = 11) or {usa} then substr({d}, 2) when {india} then substr({d}, 3) else {n['all']} end"
    return q.add(**{n["cc"]: cc, n["nat"]: nat})


def match_phone(q: Sql) -> Sql:
    phone_parts(phone_parts(q, "a"), "b")
    least = "least(length(nata), length(natb))"
    q.add(c_digits=f"case when nata <> '' and natb <> '' then case when nata = natb then 100.0::double when {least} >= 7 and right(nata, {least}) = right(natb, {least}) then 90.0::double else {lev('nata', 'natb')} end else 0.0::double end",
          c_country=f"case when cca <> '' and ccb <> '' then {exact('cca', 'ccb')} when cca = '' and ccb = '' then 90.0::double else 85.0::double end",
          ra=r"regexp_replace(a, '\D', '', 'g')", rb=r"regexp_replace(b, '\D', '', 'g')")
    q.add(c_edit=lev("ra", "rb"), sa="case when cca <> '' then trim('+' || cca || ' ' || nata) else nata end", sb="case when ccb <> '' then trim('+' || ccb || ' ' || natb) else natb end")
    said = "concat_ws('; ', case when c_digits = 100 then 'Identical national number (' || nata || ')' end, case when cca <> '' and ccb <> '' then case when cca = ccb then 'Matching country code (+' || cca || ')' else 'Different country codes (+' || cca || ' vs +' || ccb || ')' end end)"
    return scored(q, "phone", {"digits_match": "c_digits", "country_code": "c_country", "edit_distance": "c_edit"}, "sa", "sb", said)


def email_parts(q: Sql, side: str) -> Sql:
    q.add(**{f"l{side}": f"lower({side})"})
    return q.add(**{f"u{side}": f"trim(split_part(l{side}, '@', 1))", f"d{side}": f"case when contains(l{side}, '@') then trim(substr(l{side}, strpos(l{side}, '@') + 1)) else '' end"})


def match_email(q: Sql) -> Sql:
    email_parts(email_parts(q, "a"), "b")
    jaro_winkler(q, "jw", "ua", "ub")
    q.add(ld=lev("da", "db"), lu=lev("ua", "ub"), na="replace(ua, '.', '')", nb="replace(ub, '.', '')")
    q.add(c_domain="case when da <> '' and db <> '' then case when da = db then 100.0::double when ld < 75 then 0.0::double else ld end when da = '' and db = '' then 50.0::double else 0.0::double end",
          local_="case when ua = ub then 100.0::double when na = nb then 88.0::double when split_part(ua, '+', 1) = split_part(ub, '+', 1) then 92.0::double else least(jw, lu) end", c_exact=exact("la", "lb"))
    q.add(apart="c_domain = 0 and da <> '' and db <> ''")
    q.add(c_local="case when apart then least(local_, 15.0::double) else local_ end")
    said = "case when c_exact = 100 then 'Exact email address match' when c_domain = 100 then concat_ws('; ', 'Matching domain (@' || da || ')', case when na = nb then 'Dot placement variation in username' end) when apart then 'Mismatched domains (' || da || ' vs ' || db || ')' else '' end"
    return scored(q, "email", {"domain": "c_domain", "local_part": "c_local", "exact_match": "c_exact"}, "la", "lb", said)


def match_generic(q: Sql) -> Sql:
    q.add(na=normal("a"), nb=normal("b"))
    for name, f in (("c_sort", sort_ratio), ("c_set", set_ratio), ("c_jw", jaro_winkler), ("c_part", partial)):
        f(q, name, "na", "nb")
    q.add(c_exact=exact("na", "nb"), c_lev=lev("na", "nb"))
    return scored(q, "generic_text", {"exact_normalized": "c_exact", "token_sort": "c_sort", "token_set": "c_set", "jaro_winkler": "c_jw", "levenshtein": "c_lev", "partial_match": "c_part"}, "na", "nb")


def company_parts(q: Sql, side: str) -> Sql:
    n = f"cn{side}"
    q.add(**{n: normal(side, category="company")})
    q.add(**{f"ct{side}": toks(n)})
    q.add(**{f"cc{side}": f"case when len(ct{side}) > 1 and len(list_filter(ct{side}, lambda t_: length(t_) <> 1)) = 0 then array_to_string(ct{side}, '') else {n} end"})
    core = f"cc{side}"
    found = " ".join(f"when regexp_matches({core}, {text(p)}) then " + "{" + str(i) + "}" for i, p in enumerate(parse.LEGAL_FORMS))
    cores = found.format(*[collapse(f"regexp_replace({core}, {text(p)}, '', 'g')") for p in parse.LEGAL_FORMS])
    forms = found.format(*[f"regexp_extract({core}, {text(p)})" for p in parse.LEGAL_FORMS])
    return q.add(**{f"k{side}": f"case {cores} else {core} end", f"f{side}": f"case {forms} else '' end"})


def match_company(q: Sql) -> Sql:
    company_parts(company_parts(q, "a"), "b")
    jaro_winkler(q, "jwc", "ka", "kb")
    sort_ratio(q, "sc", "ka", "kb")
    set_ratio(q, "c_set", "cna", "cnb")
    jaro_winkler(q, "c_jw", "cna", "cnb")
    q.add(lc=lev("ka", "kb"))
    q.add(c_core="case when ka = '' and kb = '' then 100.0::double when ka = '' or kb = '' then 0.0::double when replace(ka, ' ', '') = replace(kb, ' ', '') then 100.0::double else greatest(jwc, sc, lc) end",
          c_form="case when fa <> '' and fb <> '' then case when fa = fb then 100.0::double when (contains(fa, 'private') and contains(fb, 'private')) or (contains(fa, 'limited') and contains(fb, 'limited')) then 90.0::double else 50.0::double end when fa = '' and fb = '' then 85.0::double else 70.0::double end")
    said = "concat_ws('; ', case when c_core >= 95 and ka <> '' then 'Identical core entity (''' || ka || ''')' end, case when fa <> '' and fb <> '' and c_form >= 90 then 'Equivalent corporate suffixes' when fa <> fb then 'Suffix variation accounted for' end)"
    return scored(q, "company", {"core_brand": "c_core", "corporate_suffix": "c_form", "token_set": "c_set", "jaro_winkler": "c_jw"}, "cna", "cnb", said)


def name_parts(q: Sql, side: str) -> Sql:
    form = lambda c: normal(c, with_numbers=False, with_expansion=False)
    titles, ends = items(parse.TITLES), items(parse.SUFFIXES)
    n = {k: f"{k}{side}" for k in ("nn", "w", "w2", "w3", "parts", "comma", "before", "after", "title", "suffix", "first", "middle", "last", "ini")}
    q.add(**{n["nn"]: form(side), n["parts"]: f"list_filter(list_transform(string_split({side}, ','), lambda t_: trim(t_)), lambda t_: t_ <> '')"})
    q.add(**{n["w"]: toks(n["nn"])})
    q.add(**{n["title"]: f"case when list_contains({titles}, {n['w']}[1]) then {n['w']}[1] end"})
    q.add(**{n["w2"]: f"case when {n['title']} is not null then {n['w']}[2:] else {n['w']} end"})
    q.add(**{n["suffix"]: f"case when list_contains({ends}, {n['w2']}[-1]) then {n['w2']}[-1] end"})
    q.add(**{n["w3"]: f"case when {n['suffix']} is not null then {n['w2']}[:-2] else {n['w2']} end", n["comma"]: f"contains({side}, ',') and len({n['parts']}) >= 2"})
    plain = lambda c: f"list_filter({toks(form(c))}, lambda t_: not list_contains({titles} || {ends}, t_))"
    rest = n["parts"] + "[2:]"
    joined_rest = f"array_to_string({rest}, ' ')"
    q.add(**{n["before"]: plain(f"({n['parts']}[1])"), n["after"]: plain(joined_rest)})
    w = n["w3"]
    q.add(**{n["first"]: f"case when len({w}) = 0 then null when {n['comma']} then {n['after']}[1] else {w}[1] end",
             n["middle"]: f"case when len({w}) = 0 then []::varchar[] when {n['comma']} then {n['after']}[2:] when len({w}) > 2 then {w}[2:-2] else []::varchar[] end",
             n["last"]: f"case when len({w}) = 0 then null when {n['comma']} then nullif(array_to_string({n['before']}, ' '), '') when len({w}) > 1 then {w}[-1] end"})
    return q.add(**{n["ini"]: f"list_transform(list_filter([{n['first']}] || {n['middle']} || [{n['last']}], lambda t_: t_ is not null), lambda t_: substr(t_, 1, 1))"})


def match_name(q: Sql) -> Sql:
    name_parts(name_parts(q, "a"), "b")
    q.add(fa="coalesce(firsta, '')", fb="coalesce(firstb, '')", la="coalesce(lasta, '')", lb="coalesce(lastb, '')")
    jaro_winkler(q, "jf", "fa", "fb")
    jaro_winkler(q, "jl", "la", "lb")
    sort_ratio(q, "so", "nna", "nnb")
    set_ratio(q, "se", "nna", "nnb")
    q.add(turned="fa <> '' and la <> '' and fb <> '' and lb <> '' and fa = lb and la = fb")
    q.add(c_first="case when turned then 100.0::double when fa <> '' and fb <> '' then case when fa = fb then 100.0::double when (length(fa) = 1 and starts_with(fb, fa)) or (length(fb) = 1 and starts_with(fa, fb)) then 92.0::double when fa = lb then 95.0::double else jf end else 70.0::double end",
          c_order="greatest(so, se)",
          c_ini="case when len(inia) > 0 and len(inib) > 0 then case when inia = inib then 100.0::double when inia[1] = inib[1] and (len(inia) = 1 or len(inib) = 1 or inia[-1] = inib[-1]) then 90.0::double else len(list_distinct(list_filter(inia, lambda t_: list_contains(inib, t_))))::double / greatest(len(inia), len(inib)) * 100.0::double end else 75.0::double end")
    q.add(c_last="case when turned then 100.0::double when la <> '' and lb <> '' then case when la = lb then 100.0::double when la = fb then 95.0::double else jl end when la = '' and lb = '' then c_first else case when (la <> '' and contains(nnb, la)) or (lb <> '' and contains(nna, lb)) then 95.0::double else 40.0::double end end")
    title = lambda c: f"upper(substr({c}, 1, 1)) || substr({c}, 2)"
    said = f"concat_ws('; ', case when fa = fb and fa <> '' then 'First name match (' || {title('fa')} || ')' end, case when la = lb and la <> '' then 'Last name match (' || {title('la')} || ')' end, case when c_order >= 95 and lower(a) <> lower(b) then 'Order inversion accounted for' end)"
    return scored(q, "person_name", {"first_name": "c_first", "last_name": "c_last", "token_order_sort": "c_order", "initials": "c_ini"}, "nna", "nnb", said)


def address_parts(q: Sql, side: str) -> Sql:
    n = {k: f"{k}{side}" for k in ("an", "postal", "house", "house_", "state", "city", "street", "local")}
    plain = lambda p: p.replace("(?U)", "").replace("(?iU)", "(?i)")
    first = lambda c, p: f"nullif(regexp_extract({c}, {text(plain(p))}, 1), '')"
    q.add(**{n["an"]: normal(side, category="address"), n["postal"]: f"coalesce({first(side, parse.POSTAL)}, upper({first(side, parse.UK_POSTAL)}))"})
    codes = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in STATE.items()) + "}"
    names = " ".join(f"when contains({n['an']}, {text(v)}) then {text(v)}" for v in dict.fromkeys(STATE.values()))
    cities = [c for c in sorted(parse.CITIES, key=lambda c: (-len(c), c)) if "-" not in c]
    found = " ".join(rf"when regexp_matches({n['an']}, '\b{c}\b') then {text(c)}" for c in cities)
    token = f"list_filter({toks(n['an'])}, lambda t_: list_contains({items(STATE)}, t_))[1]"
    q.add(**{n["house_"]: first(n["an"], parse.HOUSE), n["state"]: f"coalesce({codes}[{token}], case {names} end)", n["city"]: f"case {found} end",
             n["street"]: f"trim({first(n['an'], parse.STREET)})", n["local"]: f"trim({first(n['an'], parse.LOCALITY)})"})
    return q.add(**{n["house"]: f"case when {n['postal']} is null or {n['house_']} <> {n['postal']} then {n['house_']} end"})


def match_address(q: Sql) -> Sql:
    address_parts(address_parts(q, "a"), "b")
    for name, f, x, y in (("so", sort_ratio, "ana", "anb"), ("se", set_ratio, "ana", "anb"), ("js", jaro_winkler, "streeta", "streetb"), ("ss", sort_ratio, "streeta", "streetb"), ("ls", sort_ratio, "locala", "localb")):
        f(q, name, x, y)
    q.add(
        h=r"case when housea is not null and houseb is not null then case when housea = houseb then 100.0::double when regexp_matches(housea, '^[0-9]+$') and regexp_matches(houseb, '^[0-9]+$') then 0.0::double when regexp_replace(housea, '\D', '', 'g') = regexp_replace(houseb, '\D', '', 'g') then 80.0::double else 0.0::double end when housea is null and houseb is null then 80.0::double else 40.0::double end",
        s="case when streeta is not null and streetb is not null then greatest(ss, js) else se end",
        l="case when locala is not null and localb is not null then ls when locala is null and localb is null then so when se > 70 then 60.0::double else 30.0::double end",
        c=f"case when citya is not null and cityb is not null then {exact('citya', 'cityb')} when citya is not null and contains(anb, citya) then 100.0::double when cityb is not null and contains(ana, cityb) then 100.0::double else 50.0::double end",
        t=f"case when statea is not null and stateb is not null then {exact('statea', 'stateb')} else 50.0::double end",
        p=f"case when postala is not null and postalb is not null then {exact('postala', 'postalb')} when postala is null and postalb is null then 75.0::double else 50.0::double end",
        al="so * 0.5::double + se * 0.5::double", raw="a = b", same="ana = anb and ana <> ''")
    q.add(eq="raw or same", conflict="housea is not null and houseb is not null and h = 0", far="(citya is not null or statea is not null) and (cityb is not null or stateb is not null) and c = 0 and t = 0", place="c * 0.6::double + t * 0.4::double")
    settle = lambda v, m: f"case when eq then 100.0::double when far then 0.0::double when conflict then least({v}, {m}.0::double) else {v} end"
    q.add(c_h="case when eq then 100.0::double when far then 0.0::double else h end", c_s="case when eq then 100.0::double when far then 0.0::double else s end", c_l=settle("l", 40), c_c=settle("place", 40), c_p=settle("p", 40),
          c_t="case when eq then 100.0::double when far then least(al, 25.0::double) when conflict then least(al, 50.0::double) else al end", sa="case when raw then a else ana end", sb="case when raw then b else anb end")
    title = "array_to_string(list_transform(string_split(citya, ' '), lambda t_: upper(substr(t_, 1, 1)) || substr(t_, 2)), ' ')"
    said = f"case when raw then 'Identical address match across all components.' when same then 'Normalized identical address match.' else concat_ws('; ', case when p = 100 and postala is not null then 'Postal code match (' || postala || ')' end, case when citya = cityb then 'City match (' || {title} || ')' end, case when h = 100 and housea is not null then 'House/unit match (#' || housea || ')' when conflict then 'Different house numbers (' || housea || ' vs ' || houseb || ')' end) end"
    return scored(q, "address", {"house_number": "c_h", "street": "c_s", "locality": "c_l", "city_state": "c_c", "postal_code": "c_p", "token_similarity": "c_t"}, "sa", "sb", said)


def value_type(c: str) -> str:
    plain = lambda p: text(p.replace("(?U)", ""))
    v = clean(c)
    words = toks(f"lower({v})")
    bare = rf"list_transform({words}, lambda t_: regexp_replace(t_, '[^\w]', '', 'g'))"
    hits = f"len(list_filter({bare}, lambda t_: list_contains({items(detect.ADDRESS_TOKENS)}, t_)))"
    digits = rf"length(regexp_replace({v}, '\D', '', 'g'))"
    digit, letter, n = rf"regexp_matches({v}, '\d')", f"regexp_matches({v}, '[a-zA-Z]')", f"len({words})"
    return (
        f"(case when {v} = '' then 'generic_text' when regexp_matches({v}, {plain(detect.EMAIL)}) then 'email' "
        f"when not {letter} and {digits} between 7 and 15 and (regexp_matches({v}, {plain(detect.PHONE)}) or starts_with({v}, '+') or contains({v}, '-') or contains({v}, ' ')) then 'phone' "
        f"when regexp_matches({v}, {plain(detect.ID_CODE)}) or (length({v}) <= 24 and not contains({v}, ' ') and {digit} and {letter}) then 'id_code' "
        f"when len(list_filter({bare}, lambda t_: list_contains({items(detect.COMPANY_TOKENS)}, t_))) > 0 then 'company' "
        f"when ({digit} and {hits} >= 1) or {hits} >= 2 then 'address' "
        f"when not {digit} and {n} <= 4 and (list_contains({items(parse.TITLES)}, {bare}[1]) or (contains({v}, ',') and {n} <= 3)) then 'person_name' "
        f"when not {digit} and {n} between 2 and 3 and len(list_filter({words}, lambda t_: length(t_) < 2)) = 0 then 'person_name' else 'generic_text' end)")
