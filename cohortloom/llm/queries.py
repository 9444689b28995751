"""Queries p4, p5, p6, p8, p9 and p10 over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.alias_map import map_names
from cohortloom.llm.byte_bpe import encode_corpus
from cohortloom.llm.mixing import mix, mix_tempered
from cohortloom.llm.nearest_time import Target, nearest_in_time
from cohortloom.llm.pii import find_personal, redact_personal
from cohortloom.llm.similar import similar_pairs
from cohortloom.session import cut, load, small

WINDOWS = [Target("baseline", "t0", 90, 0), Target("m6", "t_6m", 60, 60), Target("m12", "t_12m", 60, 60)]


def _mapped_names(spark: SparkSession, d: str) -> DataFrame:
    concept = load(spark, d, "concept")
    listed = concept.where("vocabulary_id = 'RxNorm' and concept_class_id = 'Ingredient' and standard_concept = 'S'")
    # a brand is an alias of the one ingredient that its products hold
    brand = F.regexp_extract("concept_name", r"\[([^\]]+)\]\s*$", 1)
    held = F.lower(F.trim(F.regexp_extract("concept_name", r"^(.*?)\s+\d[\d.]*\s+\w+\s+[^/]*\[", 1)))
    brands = (
        concept.where("concept_class_id = 'Branded Drug'").select(brand.alias("brand"), held.alias("held"))
        .groupBy("brand").agg(F.min("held").alias("held"), F.count_distinct("held").alias("n")).where("n = 1 and held != ''")
        .join(listed.select("concept_id", F.lower("concept_name").alias("held")), "held").select("concept_id", F.col("brand").alias("concept_name"))
    )
    return map_names(load(spark, d, "chembl_mechanisms"), listed, row_id="mech_id", value="drug_name", entry_id="concept_id", name="concept_name", aliases=brands)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped_names(spark, d).select("mech_id", "concept_id")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values of no listed ingredient, with the number of their rows."""
    none = _mapped_names(spark, d).where("how = 'unmatched'").select("mech_id")
    return load(spark, d, "chembl_mechanisms").join(none, "mech_id").groupBy("drug_name").agg(F.count("*").alias("n_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    book = load(spark, d, "biomarker_codebook").select(F.col("concept_id").alias("measurement_concept_id"), "biomarker").distinct()
    items, measured = load(spark, d, "stanford_index"), load(spark, d, "filtered_measurements")
    return nearest_in_time(
        items, measured.join(small(book), "measurement_concept_id"), WINDOWS, item="drug_id", person="person_id", kind="biomarker", day="measurement_date",
        record="measurement_id", rows=len(WINDOWS) * items.count() + measured.count(),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_pairs(load(spark, d, "drug_item"), item="drug_id", fields={"target_vector": 1590, "text_embedding": 1024})
    return pairs.select("vec_field", F.col("id_a").alias("drug_id_a"), F.col("id_b").alias("drug_id_b"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(load(spark, d, "documents"), doc_id="doc_id", text="text")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    counted = encode_corpus(docs.select(F.struct("doc_id", "source").alias("k"), "text"), doc_id="k", text="text", count_only=True)
    return counted.select("k.doc_id", "k.source", "n_tokens")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), load(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), load(spark, d, "mix_targets"))[1]


def p9_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached over all sources at the flattest temperature that repeats none more than four times."""
    return mix_tempered(_sized(spark, d), max_repeats=4)[1]


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The documents of that mixture."""
    return mix_tempered(_sized(spark, d), max_repeats=4)[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(load(spark, d, "documents"), doc_id="doc_id", text="text").select("doc_id", "pii_type", "start_pos")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_personal(load(spark, d, "documents"), doc_id="doc_id", text="text")


QUERIES = {f.__name__: f for f in (p4_found, p4_unmatched, p5_found, p6_found, p8_ids, p9_mixture, p9_shares, p9_temperature, p9_tempered, p10_found, p10_redacted)}

P5 = """
WITH q AS (
  SELECT DISTINCT drug_id, person_id, 'baseline' AS target_name, t0 AS day, t0 - 90 AS lo, t0 AS hi FROM stanford_index
  UNION SELECT DISTINCT drug_id, person_id, 'm6', t_6m, t_6m - 60, t_6m + 60 FROM stanford_index
  UNION SELECT DISTINCT drug_id, person_id, 'm12', t_12m, t_12m - 60, t_12m + 60 FROM stanford_index),
m AS (SELECT f.person_id, f.measurement_date, f.measurement_id, b.biomarker FROM filtered_measurements f JOIN biomarker_codebook b ON f.measurement_concept_id = b.concept_id)
SELECT drug_id, q.person_id, biomarker, target_name, measurement_id FROM q JOIN m ON q.person_id = m.person_id AND measurement_date BETWEEN lo AND hi
QUALIFY row_number() OVER (PARTITION BY drug_id, q.person_id, biomarker, target_name, day ORDER BY abs(date_diff('day', day, measurement_date)), measurement_date DESC, measurement_id) = 1
"""

_VEC = "SELECT '{f}' AS vec_field, drug_id, list_transform({f}, lambda x: CAST(x AS DOUBLE)) AS v FROM drug_item WHERE len({f}) = {n}"
P6 = f"""
WITH a AS ({_VEC.format(f='target_vector', n=1590)} UNION ALL {_VEC.format(f='text_embedding', n=1024)}),
u AS (SELECT vec_field, drug_id, v FROM a WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT x.vec_field, x.drug_id AS i, y.drug_id AS j, round(list_cosine_similarity(x.v, y.v), 9) AS c FROM u x JOIN u y ON x.vec_field = y.vec_field AND x.drug_id <> y.drug_id),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_field, i ORDER BY c DESC, j) <= 5)
SELECT DISTINCT vec_field, least(i, j) AS drug_id_a, greatest(i, j) AS drug_id_b FROM t WHERE c >= 0.5
"""

SQL = {"p5_found": P5, "p6_found": P6}
