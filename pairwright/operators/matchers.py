"""The seven matchers: component scores of two clean values, and the result struct.

The scores that components get in special cases, and the texts of summaries, are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..config import NormalizationSettings, Thresholds, weights_for
from ..functions import metrics as M
from . import parse, scoring
from .stages import Stages


@dataclass(frozen=True)
class Options:
    settings: NormalizationSettings | None = None
    weights: dict[str, float] | None = None
    thresholds: Thresholds = Thresholds()


def _say(*parts: Column) -> Column:
    """The parts that are not null, with semicolons."""
    return F.concat_ws("; ", *parts)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _has(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def generic_text(st: Stages, a: Column, b: Column, o: Options) -> Column:
    na, nb = st.normal(a, o.settings), st.normal(b, o.settings)
    held = dict(zip(
        ["exact_normalized", "token_sort", "token_set", "jaro_winkler", "levenshtein", "partial_match"],
        st.add(exact=M.exact(na, nb), sort=M.token_sort(na, nb), set=M.token_set(na, nb), jw=M.jaro_winkler(na, nb), lev=M.levenshtein(na, nb), part=M.partial(na, nb)),
    ))
    return scoring.result(st, a, b, na, nb, held, weights_for("generic_text", o.weights), "generic_text", o.thresholds)


def address(st: Stages, a: Column, b: Column, o: Options) -> Column:
    x, y = (st.one(parse.address(st, v)) for v in (a, b))
    na, nb, ha, hb, ca, cb, sa, sb = st.add(
        na=x["normalized"], nb=y["normalized"], ha=x["house_number"], hb=y["house_number"], ca=x["city"], cb=y["city"], sa=x["state"], sb=y["state"])
    same_raw, same = a == b, (na == nb) & (na != "")
    sort, set_, jw, street_sort, local_sort = st.add(
        sort=M.token_sort(na, nb), set=M.token_set(na, nb), jw=M.jaro_winkler(x["street"], y["street"]),
        street=M.token_sort(x["street"], y["street"]), local=M.token_sort(x["locality"], y["locality"]))
    digits = [F.regexp_replace(h, r"(?U)\D", "") for h in (ha, hb)]
    both_plain = ha.rlike("^[0-9]+$") & hb.rlike("^[0-9]+$")
    house = (
        F.when(_has(ha) & _has(hb), F.when(ha == hb, 100.0).when(both_plain, 0.0).when((digits[0] == digits[1]) & (digits[0] != ""), 80.0).otherwise(0.0))
        .when(~_has(ha) & ~_has(hb), 80.0).otherwise(40.0)
    )
    street = F.when(_has(x["street"]) & _has(y["street"]), F.greatest(street_sort, jw)).otherwise(set_)
    la, lb = _has(x["locality"]), _has(y["locality"])
    locality = F.when(la & lb, local_sort).when(~la & ~lb, sort).otherwise(F.when(set_ > 70, 60.0).otherwise(30.0))
    city = F.when(_has(ca) & _has(cb), M.exact(ca, cb)).when(_has(ca) & F.contains(nb, ca), 100.0).when(_has(cb) & F.contains(na, cb), 100.0).otherwise(50.0)
    state = F.when(_has(sa) & _has(sb), M.exact(sa, sb)).otherwise(50.0)
    pa, pb = x["postal_code"], y["postal_code"]
    postal = F.when(_has(pa) & _has(pb), M.exact(pa, pb)).when(~_has(pa) & ~_has(pb), 75.0).otherwise(50.0)
    house, street, locality, city, state, postal, alike = st.add(
        house=house, street=street, locality=locality, city=city, state=state, postal=postal, alike=sort * 0.5 + set_ * 0.5)
    conflict = _has(ha) & _has(hb) & (house == 0.0)
    far = (_has(ca) | _has(sa)) & (_has(cb) | _has(sb)) & (city == 0.0) & (state == 0.0)
    equal, conflict, far = st.add(equal=same_raw | same, conflict=conflict, far=far)
    place = city * 0.6 + state * 0.4

    def settle(value, most):
        return F.when(equal, 100.0).when(far, 0.0).when(conflict, F.least(value, F.lit(most))).otherwise(value)

    held = {
        "house_number": F.when(equal, 100.0).when(far, 0.0).otherwise(house),
        "street": F.when(equal, 100.0).when(far, 0.0).otherwise(street),
        "locality": settle(locality, 40.0),
        "city_state": settle(place, 40.0),
        "postal_code": settle(postal, 40.0),
        "token_similarity": F.when(equal, 100.0).when(far, F.least(alike, F.lit(25.0))).when(conflict, F.least(alike, F.lit(50.0))).otherwise(alike),
    }
    said = _say(
        F.when((postal == 100.0) & _has(pa), _text("Postal code match (", pa, ")")),
        F.when(_has(ca) & (ca == cb), _text("City match (", F.initcap(ca), ")")),
        F.when((house == 100.0) & _has(ha), _text("House/unit match (#", ha, ")")).when(conflict, _text("Different house numbers (", ha, " vs ", hb, ")")),
    )
    said = F.when(same_raw, "Identical address match across all components.").when(same, "Normalized identical address match.").otherwise(said)
    # two equal values are shown as they are
    return scoring.result(st, a, b, F.when(same_raw, a).otherwise(na), F.when(same_raw, b).otherwise(nb), held, weights_for("address", o.weights), "address", o.thresholds, said)


def person_name(st: Stages, a: Column, b: Column, o: Options) -> Column:
    x, y = (st.one(parse.name(st, v)) for v in (a, b))
    fa, fb, la, lb = (F.lower(F.coalesce(s[f], F.lit(""))) for f in ("first_name", "last_name") for s in (x, y))
    fa, fb, la, lb, na, nb, ia, ib = st.add(fa=fa, fb=fb, la=la, lb=lb, na=x["normalized"], nb=y["normalized"], ia=x["initials"], ib=y["initials"])
    jw_first, jw_last, sort, set_ = st.add(f=M.jaro_winkler(fa, fb), l=M.jaro_winkler(la, lb), sort=M.token_sort(na, nb), set=M.token_set(na, nb))
    turned = (fa != "") & (la != "") & (fb != "") & (lb != "") & (fa == lb) & (la == fb)
    initial = ((F.char_length(fa) == 1) & F.startswith(fb, fa)) | ((F.char_length(fb) == 1) & F.startswith(fa, fb))
    first = F.when(turned, 100.0).when((fa != "") & (fb != ""), F.when(fa == fb, 100.0).when(initial, 92.0).when(fa == lb, 95.0).otherwise(jw_first)).otherwise(70.0)
    (first,) = st.add(first=first)
    last = (
        F.when(turned, 100.0)
        .when((la != "") & (lb != ""), F.when(la == lb, 100.0).when(la == fb, 95.0).otherwise(jw_last))
        .when((la == "") & (lb == ""), first)
        .otherwise(F.when(((la != "") & F.contains(nb, la)) | ((lb != "") & F.contains(na, lb)), 95.0).otherwise(40.0))
    )
    ends = (F.size(ia) == 1) | (F.size(ib) == 1) | (F.get(ia, F.size(ia) - 1) == F.get(ib, F.size(ib) - 1))
    shared = F.size(F.array_intersect(ia, ib)) / F.greatest(F.size(ia), F.size(ib)) * 100.0
    initials = F.when((F.size(ia) > 0) & (F.size(ib) > 0), F.when(ia == ib, 100.0).when((F.get(ia, F.lit(0)) == F.get(ib, F.lit(0))) & ends, 90.0).otherwise(shared)).otherwise(75.0)
    last, order, initials = st.add(last=last, order=F.greatest(sort, set_), initials=initials)
    said = _say(
        F.when((fa == fb) & (fa != ""), _text("First name match (", F.initcap(fa), ")")),
        F.when((la == lb) & (la != ""), _text("Last name match (", F.initcap(la), ")")),
        F.when((order >= 95.0) & (F.lower(a) != F.lower(b)), "Order inversion accounted for"),
    )
    held = {"first_name": first, "last_name": last, "token_order_sort": order, "initials": initials}
    return scoring.result(st, a, b, na, nb, held, weights_for("person_name", o.weights), "person_name", o.thresholds, said)


def company(st: Stages, a: Column, b: Column, o: Options) -> Column:
    x, y = (st.one(parse.company(st, v)) for v in (a, b))
    settings = o.settings or parse.COMPANY_SETTINGS
    ka, kb, fa, fb = st.add(ka=x["core"], kb=y["core"], fa=x["suffix"], fb=y["suffix"])
    na, nb = st.normal(a, settings), st.normal(b, settings)
    jw_core, sort, lev, set_, jw = st.add(core=M.jaro_winkler(ka, kb), sort=M.token_sort(ka, kb), lev=M.levenshtein(ka, kb), set=M.token_set(na, nb), jw=M.jaro_winkler(na, nb))
    tight = [F.replace(k, F.lit(" "), F.lit("")) for k in (ka, kb)]
    core = F.when((ka == "") & (kb == ""), 100.0).when((ka == "") | (kb == ""), 0.0).when(tight[0] == tight[1], 100.0).otherwise(F.greatest(jw_core, sort, lev))

    def both(word):
        return F.contains(fa, F.lit(word)) & F.contains(fb, F.lit(word))

    suffix = (
        F.when((fa != "") & (fb != ""), F.when(fa == fb, 100.0).when(both("private") | both("limited"), 90.0).otherwise(50.0))
        .when((fa == "") & (fb == ""), 85.0).otherwise(70.0)
    )
    core, suffix = st.add(core=core, suffix=suffix)
    said = _say(
        F.when((core >= 95.0) & (ka != ""), _text("Identical core entity ('", ka, "')")),
        F.when((fa != "") & (fb != "") & (suffix >= 90), "Equivalent corporate suffixes").when(fa != fb, "Suffix variation accounted for"),
    )
    held = {"core_brand": core, "corporate_suffix": suffix, "token_set": set_, "jaro_winkler": jw}
    return scoring.result(st, a, b, na, nb, held, weights_for("company", o.weights), "company", o.thresholds, said)


def email(st: Stages, a: Column, b: Column, o: Options) -> Column:
    na, nb = st.add(na=F.lower(a), nb=F.lower(b))
    x, y = st.add(x=parse.email(na), y=parse.email(nb))
    ua, ub, da, db = st.add(ua=x["local"], ub=y["local"], da=x["domain"], db=y["domain"])
    lev_domain, lev, jw = st.add(d=M.levenshtein(da, db), l=M.levenshtein(ua, ub), jw=M.jaro_winkler(ua, ub))
    domain = (
        F.when((da != "") & (db != ""), F.when(da == db, 100.0).when(lev_domain < 75.0, 0.0).otherwise(lev_domain))
        .when((da == "") & (db == ""), 50.0).otherwise(0.0)
    )
    bare = [F.replace(u, F.lit("."), F.lit("")) for u in (ua, ub)]
    base = [F.substring_index(u, "+", 1) for u in (ua, ub)]
    local = F.when(ua == ub, 100.0).when(bare[0] == bare[1], 88.0).when(base[0] == base[1], 92.0).otherwise(F.least(jw, lev))
    domain, local, exact = st.add(domain=domain, local=local, exact=F.when(na == nb, 100.0).otherwise(0.0))
    apart = (domain == 0.0) & (da != "") & (db != "")
    held = {"domain": domain, "local_part": F.when(apart, F.least(local, F.lit(15.0))).otherwise(local), "exact_match": exact}
    said = (
        F.when(exact == 100.0, "Exact email address match")
        .when(domain == 100.0, _say(_text("Matching domain (@", da, ")"), F.when(bare[0] == bare[1], "Dot placement variation in username")))
        .when(apart, _text("Mismatched domains (", da, " vs ", db, ")")).otherwise("")
    )
    return scoring.result(st, a, b, na, nb, held, weights_for("email", o.weights), "email", o.thresholds, said)


def phone(st: Stages, a: Column, b: Column, o: Options) -> Column:
    x, y = st.add(x=parse.phone(a), y=parse.phone(b))
    ca, cb, ma, mb, ra, rb = st.add(
        ca=x["country_code"], cb=y["country_code"], ma=x["national_number"], mb=y["national_number"],
        ra=F.regexp_replace(a, r"(?U)\D", ""), rb=F.regexp_replace(b, r"(?U)\D", ""))
    least = F.least(F.char_length(ma), F.char_length(mb))
    digits = F.when((ma != "") & (mb != ""), F.when(ma == mb, 100.0).when((least >= 7) & (F.right(ma, least) == F.right(mb, least)), 90.0).otherwise(M.levenshtein(ma, mb))).otherwise(0.0)
    country = F.when((ca != "") & (cb != ""), M.exact(ca, cb)).when((ca == "") & (cb == ""), 90.0).otherwise(85.0)
    digits, country, edit = st.add(digits=digits, country=country, edit=M.levenshtein(ra, rb))
    both = (ca != "") & (cb != "")
    said = _say(
        F.when(digits == 100.0, _text("Identical national number (", ma, ")")),
        F.when(both & (ca == cb), _text("Matching country code (+", ca, ")")).when(both, _text("Different country codes (+", ca, " vs +", cb, ")")),
    )
    shown = [F.when(c != "", F.trim(_text("+", c, " ", m))).otherwise(m) for c, m in ((ca, ma), (cb, mb))]
    held = {"digits_match": digits, "country_code": country, "edit_distance": edit}
    return scoring.result(st, a, b, *shown, held, weights_for("phone", o.weights), "phone", o.thresholds, said)


def id_code(st: Stages, a: Column, b: Column, o: Options) -> Column:
    x, y = st.add(x=parse.identifier(a), y=parse.identifier(b))
    ka, kb, pa, pb = st.add(ka=x["clean"], kb=y["clean"], pa=x["prefix"], pb=y["prefix"])
    exact = F.when((ka == kb) & (ka != ""), 100.0).otherwise(0.0)
    prefix = F.when((pa != "") & (pb != ""), M.exact(pa, pb)).when((pa == "") & (pb == ""), 100.0).otherwise(50.0)
    exact, prefix, lev = st.add(exact=exact, prefix=prefix, lev=M.levenshtein(ka, kb))
    said = F.when(exact == 100.0, _text("Exact identifier match (", F.upper(ka), ")")).when((prefix == 100.0) & (pa != ""), _text("Matching prefix '", F.upper(pa), "'")).otherwise("")
    held = {"exact_clean": exact, "prefix_match": prefix, "levenshtein": lev}
    return scoring.result(st, a, b, ka, kb, held, weights_for("id_code", o.weights), "id_code", o.thresholds, said)


MATCHERS = {"generic_text": generic_text, "address": address, "person_name": person_name, "company": company, "email": email, "phone": phone, "id_code": id_code}


def empty_result(a: Column, b: Column, thresholds: Thresholds) -> Column:
    """The result where a or b is empty: a full match if both are, none if one is."""
    both = (a == "") & (b == "")
    score = F.when(both, 100.0).otherwise(0.0)
    sides = [F.when(both, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(F.split(v, r"(?U)\s+"), lambda t: t != "")))) for v in (a, b)]
    return F.struct(
        score.alias("score"), score.alias("score_raw"), scoring.status(score, thresholds).alias("status"), F.lit("High").alias("confidence"), F.lit("generic_text").alias("matching_type"),
        F.struct(
            a.alias("original_a"), b.alias("original_b"), a.alias("normalized_a"), b.alias("normalized_b"), F.array().cast("array<string>").alias("matching_tokens"),
            sides[0].alias("tokens_only_in_a"), sides[1].alias("tokens_only_in_b"), F.create_map(F.lit("exact"), score).alias("component_scores"),
            F.create_map(F.lit("exact"), F.lit(100.0)).alias("applied_weights"), F.when(both, "Both values are empty.").otherwise("One value is missing.").alias("summary"),
        ).alias("explanation"),
    )
