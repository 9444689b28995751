"""Queries of sources and sinks as round trips, of catalog parts, blood draws and embeddings, with the SQL they are checked against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import vectors as V
from cohortloom.operators import audit, catalog, features, representations, vocabulary
from cohortloom.plans import proxies as X
from cohortloom.plans import reference_queries as R
from cohortloom.session import load
from cohortloom.sources import files, readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ---------------------------------------------------------------- sources and sinks, written to the shared folder and read again


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def source_csv_shards(spark: SparkSession, d: str) -> DataFrame:
    """Sharded, compressed CSV with header, as text."""
    at = files.scratch(spark)
    load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").repartition(4).write.option("header", True).option("compression", "gzip").csv(at)
    return readers.csv_shards(spark, at, "o_orderkey", "o_orderpriority", "o_orderstatus")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 'a "b", ' || o_orderpriority END AS note,
 CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders"""
)
def source_tolerant_csv(spark: SparkSession, d: str) -> DataFrame:
    """Lines with doubled quotes, some too short and some too long."""
    key = F.col("o_orderkey")
    note = F.concat(F.lit('"a ""b"", '), F.col("o_orderpriority"), F.lit('"'))
    line = F.when(key % 5 == 0, key.cast("string")).when(key % 3 == 0, F.concat_ws(",", key, note)).when(key % 2 == 0, F.concat_ws(",", key, note, "o_orderstatus")).otherwise(F.concat_ws(",", key, note, "o_orderstatus", F.lit("more")))
    at = files.scratch(spark)
    load(spark, d, "orders").select(F.lit(1).alias("g"), line.alias("value")).select("value").write.option("compression", "gzip").text(at)
    return readers.tolerant_csv(spark, at, "id", "note", "status", header=False)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_sorted_csv(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    at = files.scratch(spark)
    writers.sorted_csv(n, at, "n_name")
    kinds = dict(n.dtypes)
    return readers.typed_csv(spark, at, ", ".join(f"{c} {kinds[c]}" for c in n.columns))


@query("SELECT * FROM chembl_mechanisms")
def sink_jsonl(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "chembl_mechanisms")
    at = files.scratch(spark)
    writers.jsonl(m, at)
    return readers.jsonl(spark, at, ", ".join(f"{c} {t}" for c, t in m.dtypes))


@query("SELECT 'P' || p_partkey AS id, 'sp|P' || p_partkey || '|' || p_brand AS header, upper(replace(p_name, ' ', '')) AS sequence FROM part")
def sink_fasta(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("P"), "p_partkey")
    records = load(spark, d, "part").select(F.concat(F.lit("sp|"), key, F.lit("|"), "p_brand").alias("header"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"))
    at = files.scratch(spark)
    writers.fasta(records, at)
    return readers.fasta(spark, at)


@query("SELECT 's' || l_suppkey AS protein1, 's' || l_partkey AS protein2, CAST(l_quantity * 20 AS INTEGER) AS combined_score FROM lineitem")
def source_links(spark: SparkSession, d: str) -> DataFrame:
    """Gzip files of links, separated by blanks."""
    at = files.scratch(spark)
    rows = load(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("protein1"), F.concat(F.lit("s"), "l_partkey").alias("protein2"), (F.col("l_quantity") * 20).cast("int").alias("combined_score"))
    rows.write.option("sep", " ").option("header", True).option("compression", "gzip").csv(at)
    return readers.string_links(spark, at)


@query("SELECT c_name AS string_id, c_mktsegment AS alias, CAST(c_nationkey AS VARCHAR) AS source FROM customer")
def source_aliases(spark: SparkSession, d: str) -> DataFrame:
    at = files.scratch(spark)
    rows = load(spark, d, "customer").select(F.col("c_name").alias("#string_id"), F.col("c_mktsegment").alias("alias"), F.col("c_nationkey").alias("source"))
    rows.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(at)
    return readers.string_aliases(spark, at)


@query("SELECT count(*) AS n FROM lineitem")
def source_row_count(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(readers.row_count(spark, files.join(d, "lineitem.parquet")),)], "n long")


@query("SELECT drug_id, count(*) AS n FROM (SELECT DISTINCT drug_id, person_id, t0 FROM stanford_index WHERE drug_id IS NOT NULL) GROUP BY 1")
def sink_partitions(spark: SparkSession, d: str) -> DataFrame:
    """One folder per drug, and the drugs found again by their folders."""
    at = files.scratch(spark)
    writers.parquet(load(spark, d, "stanford_index").where("drug_id is not null").select("drug_id", "person_id", "t0").distinct(), at, partition="drug_id")
    saved = readers.saved_ids(spark, at)
    return spark.read.parquet(at).withColumn("drug_id", F.col("drug_id").cast("long")).join(saved, "drug_id").groupBy("drug_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- catalog


@query(
    f"""WITH x AS ({R.SQL['catalog_code_index']}) SELECT prescribed_concept_id AS drug_concept_id, x.drug_id AS ingredient_id, kind = 'monotherapy' AS is_monotherapy
FROM x JOIN (SELECT drug_id, min(kind) AS kind FROM drug_item GROUP BY 1) USING (drug_id)"""
)
def mapping_from_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.mapping_of_catalog(R._items(spark, d), R.catalog_code_index(spark, d))


_PARTS = """s AS (SELECT s_suppkey AS id, s_name AS name, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM supplier JOIN embeddings ON vec_id = s_suppkey)"""
_SUM = "round(sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] + z[2]) * (z[1] + z[2])))), 4)"


def _supplier_items(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as single drugs, each with the vector of its number."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("s_suppkey"), F.col("embedding").cast("array<double>").alias("target_vector"))
    s = load(spark, d, "supplier").join(e, "s_suppkey")
    return s.select(F.col("s_suppkey").alias("drug_id"), F.col("s_name").alias("name"), F.lit("monotherapy").alias("kind"), F.array("s_suppkey").alias("ingredient_concept_ids"), "target_vector", F.col("target_vector").alias("text_embedding"))


@query(
    f"WITH {_PARTS}, m AS ({X.ANCESTOR_SQL}), c AS (SELECT descendant_concept_id, min(ancestor_concept_id) AS a, max(ancestor_concept_id) AS b FROM m GROUP BY 1 HAVING count(*) = 2) "
    f"SELECT DISTINCT a AS id_a, b AS id_b, x.name || ' + ' || y.name AS name, {_SUM} AS length FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b"
)
def catalog_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Products of two suppliers as fixed combinations: names, parts and added vectors."""
    mapping = vocabulary.product_mapping(X.ancestor(spark, d), X.supplier_ingredients(spark, d))
    new, _ = catalog.fixed_combinations(mapping, _supplier_items(spark, d))
    ids = F.col("ingredient_concept_ids")
    return new.select(F.element_at(ids, 1).alias("id_a"), F.element_at(ids, 2).alias("id_b"), "name", F.round(V.norm(F.col("target_vector")), 4).alias("length"))


_TOGETHER = "SELECT DISTINCT p.l_suppkey AS a, q.l_suppkey AS b FROM lineitem p JOIN lineitem q ON p.l_orderkey = q.l_orderkey AND p.l_suppkey < q.l_suppkey"


@query(f"WITH {_PARTS} SELECT a AS id_a, b AS id_b, 'de_facto_combination' AS kind, {_SUM} AS length FROM ({_TOGETHER}) JOIN s x ON x.id = a JOIN s y ON y.id = b")
def catalog_pairs_in_orders(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that stand together in an order, as observed combinations."""
    items = _supplier_items(spark, d)
    sold = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(items.select(F.col("drug_id").alias("l_suppkey")), "l_suppkey", "left_semi")
    both = sold.withColumnRenamed("l_suppkey", "a").join(sold.withColumnRenamed("l_suppkey", "b"), "l_orderkey").where("a < b").select("b", "a")
    ids = F.col("ingredient_concept_ids")
    return catalog.observed_combinations(both, items).select(F.element_at(ids, 1).alias("id_a"), F.element_at(ids, 2).alias("id_b"), "kind", F.round(V.norm(F.col("target_vector")), 4).alias("length"))


_TESTED = R.SQL["triplet_audit"].rsplit("SELECT", 1)[0]


@query(
    _TESTED + "SELECT count(*) AS n_triplets, count(ac - ab) AS n_evaluated, count(*) FILTER (WHERE ac > ab) AS n_passed, round(count(*) FILTER (WHERE ac > ab) * 1.0::DOUBLE / count(ac - ab), 6) AS win_rate, "
    "round(avg(ac - ab), 6) AS mean_delta, round(stddev_pop(ac - ab), 6) AS sd_delta, round(median(ac - ab), 6) AS median_delta, round(avg(ac - ab) / (stddev_samp(ac - ab) / sqrt(count(ac - ab))), 3) AS t FROM d"
)
def triplet_summary(spark: SparkSession, d: str) -> DataFrame:
    t, e = R._triplets(spark, d)
    cols = ["n_triplets", "n_evaluated", "n_passed", *[F.round(c, 6).alias(c) for c in ("win_rate", "mean_delta", "sd_delta", "median_delta")], F.round("t", 3).alias("t")]
    return catalog.triplet_summary(catalog.triplet_audit(t, e)).select(*cols)


@query(_TESTED.split(", d AS")[0] + ", n AS (SELECT l_orderkey || '-' || l_linenumber AS id, unnest([a, b, c]) AS name FROM t) SELECT id, count(*) AS n_missing FROM n WHERE name NOT IN (SELECT name FROM e) GROUP BY 1")
def triplet_untestable(spark: SparkSession, d: str) -> DataFrame:
    return catalog.untestable(*R._triplets(spark, d))


@query("SELECT a.drug_id, a.name, len(b.text_embedding)::INTEGER AS size FROM (SELECT drug_id, name FROM drug_item WHERE drug_id > 0) a LEFT JOIN (SELECT drug_id, text_embedding FROM drug_item WHERE drug_id % 3 <> 0) b USING (drug_id)")
def catalog_text_merge(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings from two files; of a drug that stands in both the first file's last row counts."""
    i = load(spark, d, "drug_item")
    have = i.where("drug_id % 3 != 0").select(F.col("drug_id").alias("concept_id"), F.col("text_embedding").alias("dense_embedding"))
    rows = have.withColumns({"file": F.lit("a"), "position": F.lit(2)}).unionByName(have.withColumns({"file": F.lit("a"), "position": F.lit(1), "dense_embedding": F.lit(None)})).unionByName(have.withColumns({"file": F.lit("b"), "position": F.lit(9), "dense_embedding": F.lit(None)}))
    out = catalog.merge_text_embeddings(i.where("drug_id > 0").select(F.col("drug_id").alias("ingredient_concept_id"), "name"), rows)
    return out.select(F.col("ingredient_concept_id").alias("drug_id"), "name", F.when(F.col("text_embedding").isNotNull(), F.size("text_embedding")).alias("size"))


@query("SELECT event_id, CAST(value AS DOUBLE) AS kd_nm, CASE WHEN value IS NOT NULL THEN event_type END AS uniprot_id FROM events WHERE value IS NOT NULL")
def target_lists_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Lists of targets written as JSON text and read again."""
    e = load(spark, d, "events").where("value is not null")
    one = F.struct(F.col("event_type").alias("uniprot_id"), F.col("value").alias("kd_nm"), F.lit(1).alias("direction"), F.lit(1.0).alias("potency_weight"))
    back = catalog.targets_from_json(catalog.targets_as_json(e.select("event_id", F.array(one).alias("targets"))))
    return back.select("event_id", F.get("targets", F.lit(0))["kd_nm"].alias("kd_nm"), F.get("targets", F.lit(0))["uniprot_id"].alias("uniprot_id"))


# ---------------------------------------------------------------- audits


@query(R._PLAIN + R._MANIFEST + "SELECT drug_id, n_final + 1 AS n_final, n_final AS n_rows FROM man WHERE n_final > 0 AND drug_id % 3 = 0")
def audit_manifest_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """A manifest that is off by one for every third drug."""
    index = R.cohort_mono(spark, d)
    off = R._manifest(spark, d).withColumn("n_final", F.col("n_final") + (F.col("drug_id") % 3 == 0).cast("int"))
    return audit.manifest_matches(index, off)


_BRIDGE = "c AS (SELECT DISTINCT i.drug_id, e.ingredient_id AS comparator FROM (SELECT DISTINCT drug_id FROM stanford_index) i JOIN (SELECT DISTINCT ingredient_id FROM drug_exposure) e ON i.drug_id % 10 = e.ingredient_id % 10 AND i.drug_id <> e.ingredient_id)"


@query(
    f"WITH {_BRIDGE} SELECT i.drug_id, count(DISTINCT i.person_id) AS n_leaks FROM stanford_index i JOIN c USING (drug_id) "
    "JOIN drug_exposure e ON e.person_id = i.person_id AND e.ingredient_id = comparator AND exp_date >= t0 - 365 AND exp_date < t0 GROUP BY 1"
)
def audit_washout_comparators(spark: SparkSession, d: str) -> DataFrame:
    """Leaks by comparators: here the other ingredients with the same last digit."""
    i, e = load(spark, d, "stanford_index"), load(spark, d, "drug_exposure")
    other = e.select("ingredient_id").distinct().select(F.col("ingredient_id").alias("comparator_id"))
    bridge = i.select(F.col("drug_id").alias("ingredient_id")).distinct().join(other, F.expr("ingredient_id % 10 = comparator_id % 10 and ingredient_id != comparator_id"))
    return audit.washout_leaks(i, e, bridge)


# ---------------------------------------------------------------- representations and embeddings

_DRAWS = """i AS (SELECT DISTINCT person_id AS eid, t0 FROM stanford_index WHERE t0 IS NOT NULL), m AS (SELECT DISTINCT person_id AS eid, measurement_date AS draw FROM filtered_measurements),
w AS (SELECT eid, t0, min(draw) AS blood_draw_date FROM i JOIN m USING (eid) WHERE date_diff('day', t0, draw) / 30.4375 BETWEEN 3 AND 24 GROUP BY 1, 2)"""


def _draws(spark: SparkSession, d: str) -> DataFrame:
    index = load(spark, d, "stanford_index").where("t0 is not null").select(F.col("person_id").alias("eid"), "t0")
    return representations.blood_draws(index, load(spark, d, "filtered_measurements").select(F.col("person_id").alias("eid"), F.col("measurement_date").alias("blood_draw_date")).distinct())


@query(f"WITH {_DRAWS} SELECT eid, t0, blood_draw_date, round(date_diff('day', t0, blood_draw_date) / 30.4375, 6)::DOUBLE AS months_to_draw FROM w")
def representation_draws(spark: SparkSession, d: str) -> DataFrame:
    return _draws(spark, d).withColumn("months_to_draw", F.round("months_to_draw", 6))


@query(f"WITH {_DRAWS} SELECT DISTINCT eid AS patient_id, strftime(t0, '%Y-%m-%d %H:%M:00') AS prediction_time FROM w")
def representation_draw_times(spark: SparkSession, d: str) -> DataFrame:
    return representations.prediction_times(_draws(spark, d), "t0", "eid")


def _letters(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A model for checks: each residue's vector says whether it is an 'e'."""
    width = max(map(len, sequences)) + 2
    x, mask = np.zeros((len(sequences), width, 2)), np.zeros((len(sequences), width))
    for i, s in enumerate(sequences):
        x[i, 1 : len(s) + 1, 0] = [c == "e" for c in s]
        x[i, :, 1] = 1
        mask[i, 1 : len(s) + 1] = 1
    return x, mask


@query("WITH p AS (SELECT doc_id, text AS s FROM documents WHERE length(text) > 0) SELECT CAST(doc_id AS VARCHAR) AS uniprot_id, round((length(left(s, 1024)) - length(replace(left(s, 1024), 'e', ''))) / length(left(s, 1024))::DOUBLE, 4) AS share, 1.0::DOUBLE AS one FROM p")
def feature_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Mean residue vectors in batches, cut to 1,024 residues as the embedding is."""
    s = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uniprot_id"), F.col("text").alias("sequence"))
    v = features.sequence_embeddings(s, _letters)
    return v.select("uniprot_id", *[F.round(F.get("lm_embedding", F.lit(i)).cast("double"), 4).alias(n) for i, n in enumerate(("share", "one"))])
