"""Pairs of values derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_N = "cast({} as string)"

PAIRS = {
    "text": "select a.p_partkey as id, a.p_name as a, b.p_name as b from part a join part b on b.p_partkey = a.p_partkey + 1",
    "id_code": f"select c_custkey as id, 'CUST-' || {_N.format('c_custkey')} as a, 'CUST' || {_N.format('c_custkey + c_custkey % 3')} as b from customer",
    "phone": f"select c_custkey as id, '+91 98' || lpad({_N.format('c_custkey')}, 8, '0') as a, '098' || lpad({_N.format('c_custkey + c_custkey % 2')}, 8, '0') as b from customer",
    "email": "select p_partkey as id, replace(p_name, ' ', '.') || '@gmail.com' as a, replace(p_name, ' ', '') || case p_partkey % 3 when 0 then '@gmail.com' when 1 then '@gmial.com' else '@yahoo.com' end as b from part",
    "company": "select p_partkey as id, p_name || ' Pvt. Ltd.' as a, p_name || case p_partkey % 3 when 0 then ' Private Limited' when 1 then ' LLC' else '' end as b from part",
    "name": "select p_partkey as id, p_name as a, case p_partkey % 3 when 0 then split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) when 1 then split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) else substr(p_name, 1, 1) || '. ' || split_part(p_name, ' ', 2) end as b from part",
    "address": f"select p_partkey as id, {_N.format('p_size')} || ', ' || p_name || ' Road, Chennai' as a, {_N.format('p_size + p_partkey % 2')} || ' ' || p_name || ' Rd Chennai' as b from part",
    "units": f"select p_partkey as id, case p_partkey % 6 when 0 then 'No. ' when 1 then '#' when 2 then 'Apt ' when 3 then 'fl. ' when 4 then 'Unit: ' else 'Sector three, ' end || {_N.format('p_size')} || ', 2nd Floor, ' || p_name || ' St., P.O. Box 7' as a, {_N.format('p_size')} || 'th floor gf first ' || p_name || ' pvt ltd dr n. fl' as b from part",
    "accents": "select p_partkey as id, replace(replace(replace(replace(p_name, 'e', '\u00e9'), 'o', '\u00f6'), 'i', '\ufb01'), 'n', 'n\u0301') || ' \u0439 \u0451 \u00bd' as a, replace(replace(replace(p_name, 'a', '\u00c5'), 't', '\u0133'), 'r', '\u03ac') || case p_partkey % 4 when 0 then ' \u0390\ufb03\u339e' when 1 then ' \ud55c\uff21' when 2 then ' u\u0308x\u00b2' else '' end as b from part",
    "mixed": f"select p_partkey as id, case p_partkey % 8 when 0 then p_name || '@x-y.org' when 1 then '+1 212 555 ' || lpad({_N.format('p_partkey % 10000')}, 4, '0') when 2 then 'SKU-' || {_N.format('p_partkey')} when 3 then p_name || ' Pvt. Ltd.' when 4 then {_N.format('p_size')} || ' ' || p_name || ' Road' when 5 then p_name when 6 then '  ' else 'Dr. ' || p_name end as a, case p_partkey % 5 when 0 then p_name when 1 then p_type when 2 then p_brand when 3 then null else split_part(p_name, ' ', 1) || ', x' end as b from part",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def pairs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The columns id, a and b of a pair set."""
    sql = PAIRS[name]
    for table in ("part", "customer"):
        if f" {table}" in sql:
            spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")).createOrReplaceTempView(table)
    return spark.sql(sql)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: scoring costs far more than moving the rows of a table with fewer partitions than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
