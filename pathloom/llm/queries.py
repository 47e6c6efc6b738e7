"""Queries of the text and matching problems, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.common import table
from pathloom.llm.leaks import leaked_items
from pathloom.llm.matching import encode_records, match_records
from pathloom.llm.runs import collapse_runs
from pathloom.llm.subjects import subject_areas
from pathloom.llm.tokens import encode_corpus

GAP_S = 300
#: Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("PATHLOOM_TOKENIZERS", "/opt/tokenizers")


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    feet = 0.3048
    links = encode_records(table(spark, sf_dir, "cycleways_osm"), "linkid", ["name"], ["facility"], "lon", "lat", "length_ft", feet)
    rows = encode_records(table(spark, sf_dir, "merged"), "merged_id", ["coa_name", "arc_name"], ["coa_osm_type", "arc_osm_type"], "lon", "lat", "length_ft", feet)
    found = match_records(links, rows).withColumnsRenamed({"a_id": "linkid", "b_id": "merged_id"})
    return found.select("linkid", "merged_id", *[F.round(c, 6).alias(c) for c in ("name", "class", "overlap", "length", "apart", "score", "confidence")], "kind")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).where("confidence >= 0.5").select("linkid", "merged_id")


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = collapse_runs(table(spark, sf_dir, "merged_df"), "tripid", "pos", "linkid", "forward", "datetime", GAP_S)
    return runs.select(
        "tripid", F.col("first_pos").cast("int").alias("first_pos"), F.col("last_pos").cast("int").alias("last_pos"), "n", "linkid", "forward", F.round("duration_s", 3).alias("duration_s")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_runs(spark, sf_dir).where("n >= 2").select("tripid", "first_pos", "last_pos")


_P3 = """
with d as (select distinct tripid, pos, linkid, forward, datetime from merged_df where linkid is not null and tripid is not null and pos is not null),
f as (select *, last_value(forward ignore nulls) over (partition by tripid order by pos rows between unbounded preceding and current row) as dir,
  epoch_us(datetime) as t from d),
g as (select *, case when linkid = lag(linkid) over w and dir is not distinct from lag(dir) over w and t - lag(t) over w <= 300000000
  then 0 else 1 end as fresh from f window w as (partition by tripid order by pos)),
r as (select *, sum(fresh) over (partition by tripid order by pos rows between unbounded preceding and current row) as run from g),
s as (select tripid, run, min(pos) as first_pos, max(pos) as last_pos, count(*) as n, any_value(linkid) as linkid, any_value(dir) as forward,
  round((max(t) - min(t)) / 1000000.0, 3) as duration_s from r group by all)
"""
P3_RUNS = _P3 + "select tripid, first_pos, last_pos, n, linkid, forward, duration_s from s"
P3_FOUND = _P3 + "select tripid, first_pos, last_pos from s where n >= 2"


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subject_areas(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "subjects"), table(spark, sf_dir, "labels"))
    return found.withColumn("fraction", F.round("fraction", 6))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_subjects(spark, sf_dir).select("doc_id", "subject")


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches, "p3_found": p3_found, "p3_runs": p3_runs, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_subjects": p10_subjects}
SQL = {"p3_found": P3_FOUND, "p3_runs": P3_RUNS}
