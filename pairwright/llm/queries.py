"""Queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, langid, licenses, minhash, mixing, packing, quality_model, quality_rules, sharding, vectors


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_docs(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(_docs(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_docs(spark, sf_dir))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_docs(spark, sf_dir))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_docs(spark, sf_dir))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.digest(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_docs(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_licenses, op2_minhash, op3_mixing, op4_vectors, op5_packing, op6_chat, op7_langid, op8_quality_model, op9_sharding, op10_quality_rules)}

_REACHED = """
reached(a, b) as (select {id}, {id} from rows_ union select reached.a, linked.b from reached join linked on reached.b = linked.a),
least as (select a, min(b) as component_id from reached group by a)
"""

_OP2 = r"""
with recursive rows_ as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from rows_),
sizes as (select doc_id, len(s) as n from sets),
single as (select doc_id, unnest(s) as x from sets),
common as (select p.doc_id as a, q.doc_id as b, count(*) as c from single p join single q on p.x = q.x and p.doc_id <> q.doc_id group by 1, 2),
linked as (select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
""" + _REACHED.format(id="doc_id") + """
select sizes.doc_id, n as n_shingles, component_id, sizes.doc_id = component_id as kept from sizes join least on sizes.doc_id = least.a
"""

_OP4 = """
with recursive rows_ as (select vec_id, label, embedding::double[] as e from embeddings),
sound as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as l from rows_
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
linked as (select p.vec_id as a, q.vec_id as b from sound p join sound q on p.label = q.label and p.vec_id <> q.vec_id and len(p.e) = len(q.e)
  where list_dot_product(p.e, q.e) / (p.l * q.l) >= 0.98),
""" + _REACHED.format(id="vec_id") + """
select vec_id, (select count(*) from linked where linked.a = vec_id) as n_links, component_id, vec_id = component_id as kept from rows_ join least on vec_id = least.a
"""

#: The rest learn a model, shuffle by seeded hashes or search for good groupings, which SQL does not express.
ORACLE_SQL: dict[str, str] = {"op2_minhash": _OP2, "op3_mixing": mixing.ORACLE, "op4_vectors": _OP4}
