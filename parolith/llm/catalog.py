"""Registry of the queries on training data: name -> callable(spark, sf_dir), and name -> SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parolith.llm.common import table
from parolith.llm.p01_language import SAMPLE_TEXTS, Grams, fit_language_model, identify, sample_labelled
from parolith.llm.p02_clusters import alike_clusters, describe_clusters, gaussian_clusters
from parolith.llm.p03_near import expand_pairs, near_copies, near_groups
from parolith.llm.p04_copies import find_copies
from parolith.llm.p05_main_body import judge_lines, main_bodies
from parolith.llm.p06_entries import map_entries, near_entries
from parolith.llm.p07_forms import find_forms, normalise_forms
from parolith.llm.p08_packing import fill_report, pack
from parolith.llm.p09_mixing import mix
from parolith.llm.p10_sentences import split_sentences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _language_model(spark: SparkSession, sf_dir: str) -> Grams:
    """Fitted on a bounded sample of the labelled sayings and documents; a document is longer, so fewer are taken."""
    sayings = sample_labelled(table(spark, sf_dir, "sayings_raw"), "row_id", "saying", "saying_lang", SAMPLE_TEXTS * 5 // 6)
    texts = sample_labelled(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", SAMPLE_TEXTS // 6)
    return fit_language_model([sayings, texts])


def _languages(spark: SparkSession, sf_dir: str, cases_only: bool) -> DataFrame:
    model = _language_model(spark, sf_dir)
    sayings = identify(table(spark, sf_dir, "sayings_raw"), "row_id", [("saying", "saying_lang"), ("original", "original_lang")], model, cases_only=cases_only)
    texts = identify(table(spark, sf_dir, "documents"), "doc_id", [("text", "lang")], model, cases_only=cases_only)
    return sayings.union(texts)


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, cases_only=True).select("field", "id", "seg", "lang")


@query
def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's stretches with their language and confidence, and whether the label differs."""
    return _languages(spark, sf_dir, cases_only=False)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_clusters(table(spark, sf_dir, "items"), "ord", "claim").select(F.col("first_id").alias("first_ord"), F.col("id").alias("ord"))


@query
def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim's component of the Gaussian mixture, with its density there."""
    return gaussian_clusters(table(spark, sf_dir, "items"), "ord", "claim").withColumnRenamed("id", "ord")


@query
def p2_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component with its size and most typical claims."""
    return describe_clusters(gaussian_clusters(table(spark, sf_dir, "items"), "ord", "claim"))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links among the sayings and among the claims: three quarters of the distinct words, as TESTDATA.md has it."""
    sayings = table(spark, sf_dir, "sayings_raw").select(F.lit(0).alias("field"), F.col("row_id").alias("id"), F.col("saying").alias("text"))
    claims = table(spark, sf_dir, "items").select(F.lit(1).alias("field"), F.col("ord").alias("id"), F.col("claim").alias("text"))
    return near_copies(sayings.union(claims), (3, 4), {0})


def _field() -> Column:
    return F.when(F.col("field") == 0, "saying").otherwise("claim").alias("field")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_pairs(*_near(spark, sf_dir)).select(_field(), "id_a", "id_b")


@query
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a near copy: its group and the number of other texts it is linked to."""
    return near_groups(*_near(spark, sf_dir)).select(_field(), "id", "group_id", "n_links")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies, _ = find_copies(table(spark, sf_dir, "sayings_raw"), "row_id", "saying", "english_equivalent")
    return copies.select("first_id", F.col("id").alias("row_id"))


@query
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group of copies, with their number; unusual character forms take part as they are."""
    return find_copies(table(spark, sf_dir, "sayings_raw"), "row_id", "saying", "english_equivalent", skip_form_cases=False)[1]


ORACLES["p4_groups"] = r"""
WITH folded AS (
  SELECT row_id,
         trim(regexp_replace(replace(lower(upper(replace(replace(saying, 'ß', 'ss'), 'ẞ', 'ss'))), chr(775), ''), '[\p{P}\p{S}\p{Z}\s]+', ' ', 'g')) AS a,
         trim(regexp_replace(replace(lower(upper(replace(replace(coalesce(english_equivalent, ''), 'ß', 'ss'), 'ẞ', 'ss'))), chr(775), ''), '[\p{P}\p{S}\p{Z}\s]+', ' ', 'g')) AS b
  FROM sayings_raw WHERE saying IS NOT NULL AND regexp_matches(saying, '[^\s\p{Z}]'))
SELECT min(row_id) AS first_id, count(*) AS n_copies FROM folded
GROUP BY least(a, b), greatest(a, b) HAVING count(*) > 1
"""


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = judge_lines(table(spark, sf_dir, "page_captures"), "page_id", "source_url", "people", "saying")
    return lines.where("not main").select(F.col("page").alias("page_id"), "line_no")


@query
def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every page."""
    bodies = main_bodies(table(spark, sf_dir, "page_captures"), "page_id", "source_url", "people", "saying")
    return bodies.withColumnRenamed("page", "page_id")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = map_entries(table(spark, sf_dir, "sayings_raw"), "row_id", "people", table(spark, sf_dir, "people_metadata"), "people", keep_exact=False)
    return found.select(F.col("id").alias("row_id"), F.col("entry").alias("people"))


@query
def p6_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with the records, spellings and edits that led to it; unmatched values under the empty entry."""
    found = map_entries(table(spark, sf_dir, "sayings_raw"), "row_id", "people", table(spark, sf_dir, "people_metadata"), "people")
    return found.groupBy("entry").agg(F.count("*").alias("n_rows"), F.count_distinct("value").alias("n_spellings"), F.max("distance").alias("most_edits"))


@query
def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with all entries within its reach, and the number of records that have it."""
    spellings = table(spark, sf_dir, "sayings_raw").groupBy("people").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("row_id"))
    near = near_entries(spellings, "row_id", "people", table(spark, sf_dir, "people_metadata"), "people")
    return near.join(spellings.select("people", "n_rows"), near["value"] == spellings["people"]).select("value", "entry", "distance", "n_rows")


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_forms(table(spark, sf_dir, "sayings_raw"), "row_id", ["saying", "original"])


@query
def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with both texts in their one form."""
    made = normalise_forms(table(spark, sf_dir, "sayings_raw").select("row_id", "saying", "original"), ["saying", "original"])
    return made.select("row_id", "saying_form", "original_form")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "pack_specs"), "spec_id", "capacity_tokens")


@query
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one longer than a container, in a container of each capacity."""
    return _packed(spark, sf_dir).withColumnsRenamed({"spec": "spec_id", "id": "doc_id"})


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(_packed(spark, sf_dir)).withColumnRenamed("spec", "spec_id")


@query
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of each mixture with its turn, by virtual finish time."""
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))[1]


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=False).select(F.col("id").alias("doc_id"), "start_pos", "end_pos")


@query
def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its place and text."""
    return split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
