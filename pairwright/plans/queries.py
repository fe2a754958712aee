"""One query for each operator over the derived pairs, and its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import WEIGHT_PROFILES, NormalizationSettings, Thresholds, normalize_weights, weights_for
from ..functions import metrics as M, normalize as N
from ..functions.dictionary import AbbreviationRules
from ..functions.text import strip_accents
from ..operators import detect, parse, results
from ..sources import export, readers
from ..sources.samples import SAMPLES, sample, write_samples
from ..sources.scratch import scratch_path
from . import oracle as O
from .engine import ColumnPair, match_columns, match_multi, match_pair
from .jobs import MatchJob
from .pairs import PAIRS, pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- measures ----

def _measure(name: str, f, build) -> None:
    q = build(O.of("text"))

    @query(f"q_{name}", q.select("id, round(m, 6) as score"))
    def _run(spark, sf_dir):
        return pairs(spark, sf_dir, "text").select("id", F.round(f(F.col("a"), F.col("b")), 6).alias("score"))


_measure("exact", M.exact, lambda q: q.add(m=O.exact("a", "b")))
_measure("levenshtein", M.levenshtein, lambda q: q.add(m=O.lev("a", "b")))
_measure("token_sort", M.token_sort, lambda q: O.sort_ratio(q, "m", "a", "b"))
_measure("token_set", M.token_set, lambda q: O.set_ratio(q, "m", "a", "b"))
_measure("jaccard", M.jaccard, lambda q: O.jaccard(q, "m", "a", "b"))
_measure("partial", M.partial, lambda q: O.partial(q, "m", "a", "b"))
_measure("ngram", M.ngram, lambda q: O.ngram(q, "m", "a", "b"))
_measure("jaro", M.jaro, lambda q: O.jaro(q, "m", "a", "b"))
_measure("jaro_winkler", M.jaro_winkler, lambda q: O.jaro_winkler(q, "m", "a", "b"))
_measure("damerau_levenshtein", M.damerau_levenshtein, lambda q: O.osa(q, "m", "a", "b"))


def _all_metrics_sql() -> str:
    q = O.of("text").add(exact_match=O.exact("a", "b"), levenshtein=O.lev("a", "b"))
    for name, f in (("damerau_levenshtein", O.osa), ("jaro", O.jaro), ("jaro_winkler", O.jaro_winkler), ("token_sort", O.sort_ratio), ("token_set", O.set_ratio), ("jaccard", O.jaccard), ("partial_match", O.partial), ("ngram", O.ngram)):
        f(q, name, "a", "b")
    return q.select("id, " + ", ".join(f"round({m}, 1) as {m}" for m in M.METRICS))


@query("q_all_metrics", _all_metrics_sql())
def _all_metrics(spark, sf_dir):
    return pairs(spark, sf_dir, "text").select("id", M.all_metrics(F.col("a"), F.col("b")).alias("m")).select("id", "m.*")


# ---- normal form ----

def _columns(name: str, pair_set: str, columns: Callable[[Column, Column], dict[str, Column]], sql: dict[str, str]) -> None:
    @query(name, O.of(pair_set).select("id, " + ", ".join(f"{v} as {k}" for k, v in sql.items())))
    def _run(spark, sf_dir):
        return pairs(spark, sf_dir, pair_set).select("id", *[v.alias(k) for k, v in columns(F.col("a"), F.col("b")).items()])


def _register_normal_forms() -> None:
    for mode in ("conservative", "standard", "aggressive"):
        s = NormalizationSettings(mode=mode)
        _columns(f"q_normalize_{mode}", "units", lambda a, b, s=s: {"x": N.normalize(a, s), "y": N.normalize(b, s)}, {"x": O.normal("a", mode), "y": O.normal("b", mode)})
    stop = NormalizationSettings(remove_stopwords=True, normalize_numbers=False, expand_abbreviations=False)
    kept = f"list_filter({O.toks(O.normal('a', with_numbers=False, with_expansion=False))}, lambda t_: not list_contains({O.items(N.STOPWORDS)}, t_))"
    _columns("q_stopwords", "company", lambda a, b: {"x": N.normalize(F.concat(F.lit("The "), a, F.lit(" of and by B")), stop)},
             {"x": f"array_to_string({kept}, ' ')".replace("coalesce(a, '')", "coalesce('The ' || a || ' of and by B', '')")})
    _columns("q_tokenize", "address", lambda a, b: {"x": F.array_join(N.tokenize(a), "|"), "n": F.size(N.tokenize(b)).cast("long")}, {"x": f"array_to_string({O.toks(O.normal('a'))}, '|')", "n": f"len({O.toks(O.normal('b'))})"})
    _columns("q_numbers", "units", lambda a, b: {"x": N.number_expressions(F.lower(a)), "y": N.number_expressions(F.lower(b))}, {"x": O.numbers("lower(a)"), "y": O.numbers("lower(b)")})
    _columns("q_extract_numbers", "units", lambda a, b: {"x": F.array_join(N.extract_numbers(a), "|"), "n": F.size(N.extract_numbers(b)).cast("long")},
             {"x": r"array_to_string(regexp_extract_all(a, '\b\d+\b'), '|')", "n": r"len(regexp_extract_all(b, '\b\d+\b'))"})
    for name, pair_set, category, rules in (
        ("company", "company", "company", None), ("address", "units", "address", None), ("all", "units", None, None), ("custom", "units", "none", AbbreviationRules().add("Ring", "circle").add("pvt", "own"))):
        _columns(f"q_abbrev_{name}", pair_set, lambda a, b, rules=rules, category=category: {"x": N.expand(F.lower(a), rules, category), "y": N.expand(F.lower(b), rules, category)}, {"x": O.expand("lower(a)", category, rules), "y": O.expand("lower(b)", category, rules)})
    _columns("q_accents", "accents", lambda a, b: {"x": strip_accents(a), "y": strip_accents(b)}, {"x": O.accents("a"), "y": O.accents("b")})
    _columns("q_parse_email", "email", lambda a, b: {"local": parse.email(a)["local"], "domain": parse.email(a)["domain"]}, {"local": "trim(split_part(lower(a), '@', 1))", "domain": "trim(split_part(lower(a), '@', 2))"})
    _columns("q_detect_value", "mixed", lambda a, b: {"x": detect.value_type(a), "y": detect.value_type(b)}, {"x": O.value_type("a"), "y": O.value_type("b")})
    x, y = O.value_type("a"), O.value_type("b")
    _columns("q_auto_type", "mixed", lambda a, b: {"kind": detect.pair_type(a, b)}, {"kind": f"case when {x} <> 'generic_text' then {x} else {y} end"})


_register_normal_forms()


# ---- parsers ----

@query("q_parse_phone", O.phone_parts(O.phone_parts(O.of("phone"), "a"), "b").select("id, cca as cc_a, nata as nat_a, exta as ext_a, ccb as cc_b, natb as nat_b"))
def _parse_phone(spark, sf_dir):
    df = pairs(spark, sf_dir, "phone").select("id", parse.phone(F.col("a")).alias("x"), parse.phone(F.col("b")).alias("y"))
    return df.select("id", F.col("x.country_code").alias("cc_a"), F.col("x.national_number").alias("nat_a"), F.col("x.extension").alias("ext_a"), F.col("y.country_code").alias("cc_b"), F.col("y.national_number").alias("nat_b"))


@query("q_parse_id", O.id_parts(O.of("id_code"), "a").select("id, ka as clean, pa as prefix, na as num"))
def _parse_id(spark, sf_dir):
    return pairs(spark, sf_dir, "id_code").select("id", parse.identifier(F.col("a")).alias("x")).select("id", "x.*")


@query("q_parse_address", O.address_parts(O.of("address"), "a").select("id, ana as normalized, housea as house_number, streeta as street, locala as locality, citya as city, statea as state, postala as postal_code"))
def _parse_address(spark, sf_dir):
    return parse.parse_address(pairs(spark, sf_dir, "address"), "a").select("id", "address.*").drop("raw")


@query("q_parse_name", O.name_parts(O.of("name"), "b").select("id, nnb as normalized, titleb as title, firstb as first_name, array_to_string(middleb, '|') as middle, lastb as last_name, suffixb as suffix, array_to_string(inib, '') as initials"))
def _parse_name(spark, sf_dir):
    df = parse.parse_name(pairs(spark, sf_dir, "name"), "b").select("id", "name.*").drop("raw")
    return df.select("id", "normalized", "title", "first_name", F.array_join("middle_names", "|").alias("middle"), "last_name", "suffix", F.array_join("initials", "").alias("initials"))


@query("q_company_core", O.company_parts(O.of("company"), "b").select("id, kb as core, fb as suffix"))
def _company_core(spark, sf_dir):
    return parse.parse_company(pairs(spark, sf_dir, "company"), "b").select("id", "company.*")


# ---- matchers ----

_RESULT = "id, score, round(score_raw, 6) as score_raw, status, confidence, matching_type, normalized_a, normalized_b, matching_tokens, only_a, only_b, summary"


def _flat(df: DataFrame) -> DataFrame:
    m, e = F.col("match"), F.col("match.explanation")
    return df.select(
        "id", m["score"].alias("score"), F.round(m["score_raw"], 6).alias("score_raw"), m["status"].alias("status"), m["confidence"].alias("confidence"), m["matching_type"].alias("matching_type"),
        e["normalized_a"].alias("normalized_a"), e["normalized_b"].alias("normalized_b"), F.array_join(e["matching_tokens"], " ").alias("matching_tokens"),
        F.array_join(e["tokens_only_in_a"], " ").alias("only_a"), F.array_join(e["tokens_only_in_b"], " ").alias("only_b"), e["summary"].alias("summary"))


def _matcher(name: str, pair_set: str, kind: str, build) -> None:
    @query(f"q_match_{name}", build(O.of(pair_set)).select(_RESULT))
    def _run(spark, sf_dir):
        return _flat(match_columns(pairs(spark, sf_dir, pair_set), "a", "b", kind))


_matcher("id", "id_code", "id_code", O.match_id)
_matcher("phone", "phone", "phone", O.match_phone)
_matcher("email", "email", "email", O.match_email)
_matcher("company", "company", "company", O.match_company)
_matcher("name", "name", "person_name", O.match_name)
_matcher("address", "address", "address", O.match_address)
_matcher("generic", "text", "generic_text", O.match_generic)


def _auto_sql() -> str:
    """Each type's matcher over the rows of that type, and the rows with an empty side."""
    x, y = O.value_type("a"), O.value_type("b")
    typed = O.Sql(f"select id, {O.clean('a')} as a, {O.clean('b')} as b from ({PAIRS['mixed']})").add(kind=f"case when a = '' or b = '' then 'empty' when {x} <> 'generic_text' then {x} else {y} end").query
    parts = [build(O.Sql(f"select id, a, b from ({typed}) where kind = '{kind}'")).select(_RESULT) for kind, build in (
        ("generic_text", O.match_generic), ("address", O.match_address), ("person_name", O.match_name), ("company", O.match_company), ("email", O.match_email), ("phone", O.match_phone), ("id_code", O.match_id))]
    both = "a = '' and b = ''"
    score = f"case when {both} then 100.0::double else 0.0::double end"
    words = lambda c: O.joined(f"list_distinct({O.toks(c)})")
    parts.append(f"select id, {score} as score, {score} as score_raw, case when {both} then 'Strong Match' else 'No Match' end as status, 'High' as confidence, 'generic_text' as matching_type, a as normalized_a, b as normalized_b, '' as matching_tokens, {words('a')} as only_a, {words('b')} as only_b, case when {both} then 'Both values are empty.' else 'One value is missing.' end as summary from ({typed}) where kind = 'empty'")
    return " union all ".join(parts)


@query("q_match_auto", _auto_sql())
def _match_auto(spark, sf_dir):
    return _flat(match_columns(pairs(spark, sf_dir, "mixed"), "a", "b", "auto", per_row=True))


# ---- scores, weights and thresholds ----

def _ids(spark, sf_dir, **options) -> DataFrame:
    return match_columns(pairs(spark, sf_dir, "id_code"), "a", "b", "id_code", **options)


def _id_job(spark, sf_dir) -> MatchJob:
    return MatchJob.columns(pairs(spark, sf_dir, "id_code").withColumnRenamed("id", "row_id"), scratch_path(spark, "job"), "a", "b", "id_code")


_ID = O.match_id(O.of("id_code"))
_LIGHT = "id as row_index, score, status, confidence, matching_type, a as original_a, b as original_b, summary"


def _light(spark, sf_dir) -> DataFrame:
    return results.light(_ids(spark, sf_dir), "id")


@query("q_status", _ID.select("status, count(*) as n", "group by status"))
def _status(spark, sf_dir):
    return _ids(spark, sf_dir).groupBy(F.col("match.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("q_confidence", _ID.select("confidence, count(*) as n", "group by confidence"))
def _confidence(spark, sf_dir):
    return _ids(spark, sf_dir).groupBy(F.col("match.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("q_explain_tokens", _ID.select("id, matching_tokens, only_a, only_b, round(c_exact, 1) as exact_clean, round(c_prefix, 1) as prefix_match, round(c_lev, 1) as levenshtein"))
def _explain_tokens(spark, sf_dir):
    e, c = F.col("match.explanation"), F.col("match.explanation.component_scores")
    return _ids(spark, sf_dir).select(
        "id", F.array_join(e["matching_tokens"], " ").alias("matching_tokens"), F.array_join(e["tokens_only_in_a"], " ").alias("only_a"), F.array_join(e["tokens_only_in_b"], " ").alias("only_b"),
        *[c[k].alias(k) for k in ("exact_clean", "prefix_match", "levenshtein")])


@query("q_stats", _ID.select("count(*) as total, count(*) filter (status = 'Strong Match') as strong, count(*) filter (status = 'Likely Match') as likely, count(*) filter (status = 'Possible Match') as possible, count(*) filter (status = 'Weak Match') as weak, count(*) filter (status = 'No Match') as no_match, coalesce(round(avg(score), 1), 0.0) as avg_score"))
def _stats(spark, sf_dir):
    return results.statistics(_ids(spark, sf_dir))


_CUSTOM = {"exact_clean": 10.0, "levenshtein": 60.0, "unknown": 5.0}


@query("q_custom_weights", O.match_id(O.of("id_code"), weights=weights_for("id_code", _CUSTOM)).select("id, round(score_raw, 6) as score_raw, status, confidence"))
def _custom_weights(spark, sf_dir):
    return _ids(spark, sf_dir, weights=_CUSTOM).select("id", F.round("match.score_raw", 6).alias("score_raw"), "match.status", "match.confidence")


@query("q_thresholds", O.match_id(O.of("id_code"), thresholds=(99.0, 28.0, 26.0, 10.0)).select("id, score, status"))
def _thresholds(spark, sf_dir):
    return _ids(spark, sf_dir, thresholds=Thresholds(99.0, 28.0, 26.0, 10.0)).select("id", "match.score", "match.status")


@query("q_weight_profiles", "select * from (values " + ", ".join(f"('{k}', '{c}', {w}::double)" for k, p in WEIGHT_PROFILES.items() for c, w in p.items()) + ") as t(matching_type, component, weight)")
def _weight_profiles(spark, sf_dir):
    return spark.createDataFrame([(k, c, w) for k, p in WEIGHT_PROFILES.items() for c, w in p.items()], "matching_type string, component string, weight double")


@query("q_normalize_weights", "select * from (values ('exact_normalized', 40.0::double), ('token_sort', 16.0::double), ('token_set', 12.0::double), ('jaro_winkler', 16.0::double), ('levenshtein', 12.0::double), ('partial_match', 4.0::double)) as t(component, weight)")
def _normalize_weights(spark, sf_dir):
    return spark.createDataFrame(list(normalize_weights({"exact_normalized": 50.0, "token_sort": 20.0, "token_set": 15.0, "jaro_winkler": 20.0, "levenshtein": 15.0, "partial_match": 5.0}).items()), "component string, weight double")


# ---- several columns, empty values, detection of columns ----

_MULTI = PAIRS["id_code"].replace(" as a", " as id_a").replace(" as b", " as id_b").replace(" from customer", ", " + PAIRS["phone"].removeprefix("select c_custkey as id, ").replace(" as a", " as tel_a").replace(" as b", " as tel_b").removesuffix(" from customer") + " from customer")


def _multi_sql() -> str:
    ids = O.match_id(O.Sql(f"select id, id_a as a, id_b as b from ({_MULTI})")).select("id, score")
    tel = O.match_phone(O.Sql(f"select id, tel_a as a, tel_b as b from ({_MULTI})")).select("id, score")
    both = O.Sql(f"select x.id, x.score as s1, y.score as s2 from ({ids}) x join ({tel}) y on x.id = y.id")
    both.add(score_raw=f"greatest(0.0::double, least(100.0::double, (s1 * {75.0 / 100.0!r}::double + s2 * {25.0 / 100.0!r}::double) / {0.75 + 0.25!r}::double))")
    return both.select(f"id, round(score_raw, 1) as score, {O.status('score_raw')} as status, {O.confidence('score_raw', ['s1', 's2'])} as confidence, 'multi_column' as matching_type")


@query("q_multi_column", _multi_sql())
def _multi(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    df = match_multi(spark.sql(_MULTI), [ColumnPair("id_a", "id_b", "id_code", 3.0), ColumnPair("tel_a", "tel_b", "phone", 1.0)])
    return df.select("id", "match.score", "match.status", "match.confidence", "match.matching_type")


@query("q_empty_rules", "select * from (values (1, 100.0::double, 'Strong Match', 'High', 'generic_text', 'Both values are empty.'), (2, 0.0::double, 'No Match', 'High', 'generic_text', 'One value is missing.'), (3, 0.0::double, 'No Match', 'High', 'generic_text', 'One value is missing.'), (4, 100.0::double, 'Strong Match', 'High', 'generic_text', 'Both values are empty.')) as t(id, score, status, confidence, matching_type, summary)")
def _empty_rules(spark, sf_dir):
    df = spark.createDataFrame([(1, "", None), (2, "x", " "), (3, None, "555"), (4, "\t", "  ")], "id int, a string, b string")
    return match_columns(df, "a", "b", "phone").select("id", "match.score", "match.status", "match.confidence", "match.matching_type", "match.explanation.summary")


@query("q_detect_column", "select * from (values ('c_name', true, 'person_name', 0.9::double), ('c_name', false, 'id_code', 1.0::double), ('p_name', false, 'person_name', 1.0::double), ('s_name', false, 'id_code', 1.0::double)) as t(column_name, by_header, kind, sure)")
def _detect_column(spark, sf_dir):
    out = []
    for table, column, header in (("customer", "c_name", True), ("customer", "c_name", False), ("part", "p_name", False), ("supplier", "s_name", False)):
        out.append((column, header, *detect.column_type(spark.read.parquet(f"{sf_dir}/{table}.parquet"), column, header)))
    return spark.createDataFrame(out, "column_name string, by_header boolean, kind string, sure double")


@query("q_type_frequency", f"select kind as matching_type, count(*) as n, round(count(*)::double / sum(count(*)) over (), 2) as share from ({O.of('mixed').add(kind=O.value_type('a')).query}) group by kind")
def _type_frequency(spark, sf_dir):
    return results.type_frequency(pairs(spark, sf_dir, "mixed"), detect.value_type(F.col("a")))


# ---- what is done with results ----

@query("q_light", _ID.select(_LIGHT))
def _light_rows(spark, sf_dir):
    return _light(spark, sf_dir)


@query("q_filter_status", _ID.select(_LIGHT, "where status = 'Weak Match'"))
def _filter_status(spark, sf_dir):
    return results.by_status(_light(spark, sf_dir), "Weak Match")


@query("q_min_score", _ID.select(_LIGHT, "where score >= 27.5"))
def _min_score(spark, sf_dir):
    return results.by_min_score(_light(spark, sf_dir), 27.5)


@query("q_search", _ID.select(_LIGHT, "where contains(lower(a), 'cust-10') or contains(lower(b), 'cust-10') or contains(lower(summary), 'cust-10')"))
def _search(spark, sf_dir):
    return results.search(_light(spark, sf_dir), "  CUST-10 ")


@query("q_sort", _ID.select("id as row_index, row_number() over (order by score desc, id) as place"))
def _sort(spark, sf_dir):
    return results.with_row_id(results.sort(_light(spark, sf_dir)), "place").select("row_index", "place")


@query("q_page", _ID.select(_LIGHT, "order by score desc, id limit 100 offset (select (least(3, greatest(1, (count(*) + 99) // 100)) - 1) * 100 from customer)"))
def _page(spark, sf_dir):
    return _id_job(spark, sf_dir).run().page(3, 100)


@query("q_explain_row", _ID.select("id as row_index, score, status, normalized_a, normalized_b, matching_tokens, summary", "where id = 7"))
def _explain_row(spark, sf_dir):
    e = F.col("explanation")
    return results.explain_row(_ids(spark, sf_dir), 7, "id").select("row_index", "score", "status", e["normalized_a"].alias("normalized_a"), e["normalized_b"].alias("normalized_b"), F.array_join(e["matching_tokens"], " ").alias("matching_tokens"), e["summary"].alias("summary"))


_EXPORTED = _ID.select('id as "Row", a as "Original_a", b as "Original_b", normalized_a as "Normalized_a", normalized_b as "Normalized_b", score as "Match_Score", status as "Match_Status", confidence as "Confidence", matching_type as "Match_Type", replace(matching_tokens, \' \', \', \') as "Matching_Tokens", summary as "Match_Summary", \'{"exact_clean":\' || round(c_exact, 1)::varchar || \',"prefix_match":\' || round(c_prefix, 1)::varchar || \',"levenshtein":\' || round(c_lev, 1)::varchar || \'}\' as "Component_Scores"')


@query("q_export_table", _EXPORTED)
def _export_table(spark, sf_dir):
    return results.export_table(_ids(spark, sf_dir), "a", "b", "id")


# ---- files and jobs ----

_BACK = f"select cast(id as string) as id, a, b from ({PAIRS['address']})"


def _text_table(spark, sf_dir) -> DataFrame:
    return pairs(spark, sf_dir, "address").select(F.col("id").cast("string").alias("id"), "a", "b")


@query("q_csv_round_trip", _BACK)
def _csv(spark, sf_dir):
    path = scratch_path(spark, "table.csv")
    export.write_csv(_text_table(spark, sf_dir), path)
    return readers.read_table(spark, path)


@query("q_json_round_trip", _BACK)
def _json(spark, sf_dir):
    path = scratch_path(spark, "table.json")
    _text_table(spark, sf_dir).write.json(path)
    return readers.read_table(spark, path)


@query("q_xlsx_round_trip", _BACK)
def _xlsx(spark, sf_dir):
    path = scratch_path(spark, "table.xlsx")
    export.write_xlsx(_text_table(spark, sf_dir), path)
    return readers.read_table(spark, path)


@query("q_samples", "select * from (values " + ", ".join(f"('{k}', {len(v[1])}::bigint, {len(v[0])}::bigint, '{v[3]}')" for k, v in SAMPLES.items()) + ") as t(sample, n, columns, kind)")
def _samples(spark, sf_dir):
    return spark.createDataFrame([(k, sample(spark, k).count(), len(v[0]), v[3]) for k, v in SAMPLES.items()], "sample string, n long, columns long, kind string")


@query("q_preview", "select count(*) as n, 3::bigint as columns_count, 5::bigint as preview from part")
def _preview(spark, sf_dir):
    info = readers.describe(_text_table(spark, sf_dir))
    return spark.createDataFrame([(info.rows, info.columns_count, len(info.preview))], "n long, columns_count long, preview long")


@query("q_job", _ID.select("count(*) as total, round(avg(score), 1) as avg_score, 1.0::double as progress"))
def _job(spark, sf_dir):
    job = _id_job(spark, sf_dir).start()
    job.wait()
    return job.statistics().select("total", "avg_score", F.lit(job.progress()).alias("progress"))


@query("q_stream", _ID.select("id, score, status"))
def _stream(spark, sf_dir):
    from ..streaming.stream import match_stream, write_matches

    source, out, state = (scratch_path(spark, n) for n in ("source", "out", "state"))
    pairs(spark, sf_dir, "id_code").repartition(4).write.parquet(source)
    rows = spark.readStream.schema("id long, a string, b string").option("maxFilesPerTrigger", 2).parquet(source)
    write_matches(match_stream(rows, "a", "b", "id_code").select("id", "match.score", "match.status"), out, state).awaitTermination()
    return spark.read.parquet(out)


@query("q_export_file", f'select "Row"::varchar as "Row", "Match_Score"::varchar as "Match_Score", "Match_Status", "Match_Summary", "Component_Scores" from ({_EXPORTED})')
def _export_file(spark, sf_dir):
    path = _id_job(spark, sf_dir).run().export(scratch_path(spark, "matches.csv"))
    return readers.read_table(spark, path).select("Row", "Match_Score", "Match_Status", "Match_Summary", "Component_Scores")


@query("q_load_table", f"select (select count(*) from ({_BACK})) as n, k.column_name, k.kind from (values ('id', 'id_code'), ('a', 'address'), ('b', 'address')) as k(column_name, kind)")
def _load_table(spark, sf_dir):
    path = scratch_path(spark, "loaded.csv")
    export.write_csv(_text_table(spark, sf_dir), path)
    _, info, kinds = readers.load_table(spark, path, "loaded_pairs")
    return spark.createDataFrame([(spark.table("loaded_pairs").count(), c, kinds[c][0]) for c in info.columns], "n long, column_name string, kind string")


@query("q_sample_files", "select * from (values " + ", ".join(f"('{k}', {len(v[1])}::bigint, {len(v[0])}::bigint)" for k, v in SAMPLES.items()) + ") as t(sample, n, columns)")
def _sample_files(spark, sf_dir):
    folder = scratch_path(spark, "samples")
    out = []
    for name, path in zip(SAMPLES, write_samples(folder, spark)):
        df = readers.read_table(spark, path)
        out.append((name, df.count(), len(df.columns)))
    return spark.createDataFrame(out, "sample string, n long, columns long")


# ---- errors, single pairs, dispatch ----

def _refused(act) -> str:
    try:
        act()
    except ValueError as e:
        return str(e)
    return ""


@query("q_unsupported_format", "select * from (values ('x.docx', true), ('x.xls', true), ('x', true)) as t(path, refused)")
def _unsupported_format(spark, sf_dir):
    return spark.createDataFrame([(p, _refused(lambda p=p: readers.read_table(spark, p)) != "") for p in ("x.docx", "x.xls", "x")], "path string, refused boolean")


@query("q_column_validation", "select * from (values ('no such column: missing; there are id, a, b'), ('no such column: n1, n2; there are id, a, b'), ('no column pairs')) as t(message)")
def _column_validation(spark, sf_dir):
    df = pairs(spark, sf_dir, "id_code")
    acts = [lambda: match_columns(df, "a", "missing"), lambda: match_multi(df, [ColumnPair("n1", "n2")]), lambda: match_multi(df, [])]
    return spark.createDataFrame([(_refused(act),) for act in acts], "message string")


_EDITED = AbbreviationRules().add("Ring", "circle").add("fl", "flight")
_columns("q_dictionary_edits", "units", lambda a, b: {"x": N.expand(F.lower(a), _EDITED.remove("RING"), "none"), "y": N.expand(F.lower(b), _EDITED.clear(), "address"), "z": N.expand(F.lower(b), _EDITED, "none")},
         {"x": O.expand("lower(a)", "none", AbbreviationRules((("fl", "flight"),))), "y": O.expand("lower(b)", "address"), "z": O.expand("lower(b)", "none", _EDITED)})


#: (a, b, type): each pair is matched by itself.
_SINGLE = [("CUST-1", "cust1", "auto"), ("CUST-1", "CUST-2", "id_code"), ("a@x.org", "a@x.org", "AUTO"), ("", "x", "phone"), ("+1 212 555 0144", "12125550144", "phone")]


@query("q_match_pair", "select * from (values ('CUST-1', 'cust1', 100.0::double, 'Strong Match', 'id_code'), ('CUST-1', 'CUST-2', 27.0::double, 'Weak Match', 'id_code'), ('a@x.org', 'a@x.org', 100.0::double, 'Strong Match', 'email'), ('', 'x', 0.0::double, 'No Match', 'generic_text'), ('+1 212 555 0144', '12125550144', 100.0::double, 'Strong Match', 'phone')) as t(a, b, score, status, matching_type)")
def _match_pair(spark, sf_dir):
    found = [match_pair(spark, a, b, kind).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "score", "status", "matching_type") for a, b, kind in _SINGLE]
    return reduce(DataFrame.union, found)


@query("q_job_type", " union all ".join(f"select '{k}' as pair_set, '{v}' as kind" for k, v in (("id_code", "id_code"), ("phone", "phone"), ("email", "email"), ("company", "company"), ("address", "address"))))
def _job_type(spark, sf_dir):
    found = [(k, detect.job_type(pairs(spark, sf_dir, k), "a", "b", "auto")) for k in ("id_code", "phone", "email", "company", "address")]
    return spark.createDataFrame(found, "pair_set string, kind string")


@query("q_match_auto_job", _ID.select("id, score, status, matching_type"))
def _match_auto_job(spark, sf_dir):
    return match_columns(pairs(spark, sf_dir, "id_code"), "a", "b", "auto").select("id", "match.score", "match.status", "match.matching_type")


@query("q_dispatch", "select id, x.score as typed, y.score as unknown, y.matching_type as kind from (" + _ID.select("id, score") + ") x join (" + O.match_generic(O.of("id_code")).select("id, score, matching_type") + ") y using (id)")
def _dispatch(spark, sf_dir):
    df = pairs(spark, sf_dir, "id_code")
    typed = match_columns(df, "a", "b", "ID_Code").select("*", F.col("match.score").alias("typed")).drop("match")
    return match_columns(typed, "a", "b", "no such type").select("id", "typed", F.col("match.score").alias("unknown"), F.col("match.matching_type").alias("kind"))
