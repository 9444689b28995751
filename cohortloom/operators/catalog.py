"""The drug catalog as DataFrames: single drugs, combinations, the code index and text embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import vectors as V
from cohortloom.functions.ids import synthetic_pair_id
from cohortloom.operators import stats

ITEM = ["drug_id", "name", "kind", "ingredient_concept_ids", "target_vector", "text_embedding"]


def merge_text_embeddings(catalog: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Catalog with text_embedding, null where none exists; of several rows per concept the first file and its last row count
    (columns file, position, if present)."""
    order = [F.col(c) for c in ("file",) if c in embeddings.columns] + [F.desc("position") if "position" in embeddings.columns else F.lit(0)]
    w = Window.partitionBy("concept_id").orderBy(*order)
    one = embeddings.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("concept_id").alias("ingredient_concept_id"), F.col("dense_embedding").alias("text_embedding"))
    return catalog.join(one, "ingredient_concept_id", "left")


def single_items(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        F.col("ingredient_concept_id").alias("drug_id"), F.col("ingredient_name").alias("name"), F.lit("monotherapy").alias("kind"),
        F.array("ingredient_concept_id").alias("ingredient_concept_ids"), F.col("ua").cast("array<double>").alias("target_vector"), F.col("text_embedding").cast("array<double>").alias("text_embedding"),
    )


def _combined(pairs: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    side = lambda s: items.select(F.col("drug_id").alias(f"id_{s}"), F.col("name").alias(f"name_{s}"), F.col("target_vector").alias(f"v_{s}"), F.col("text_embedding").alias(f"t_{s}"))
    both = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    return both.select(
        synthetic_pair_id(F.col("id_a"), F.col("id_b")).alias("drug_id"), F.concat_ws(" + ", "name_a", "name_b").alias("name"), F.lit(kind).alias("kind"),
        F.array("id_a", "id_b").alias("ingredient_concept_ids"), V.add(F.col("v_a"), F.col("v_b")).alias("target_vector"),
        V.unit(V.mean_of_two(F.col("t_a"), F.col("t_b")), 1e-9).alias("text_embedding"),
    )


def fixed_combinations(mapping: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, code rows) of two-ingredient products whose ingredients are both in the catalog; products of three and more are left out."""
    combos = mapping.where("not is_monotherapy").groupBy("drug_concept_id").agg(F.sort_array(F.collect_set("ingredient_id")).alias("ids")).where(F.size("ids") == 2)
    codes = combos.select(F.element_at("ids", 1).alias("id_a"), F.element_at("ids", 2).alias("id_b"), "drug_concept_id")
    codes = codes.join(items.select(F.col("drug_id").alias("id_a")), "id_a", "left_semi").join(items.select(F.col("drug_id").alias("id_b")), "id_b", "left_semi")
    new = _combined(codes.select("id_a", "id_b").distinct(), items, "fixed_combination")
    return new, codes.select(synthetic_pair_id(F.col("id_a"), F.col("id_b")).alias("drug_id"), F.col("drug_concept_id").alias("prescribed_concept_id"))


def large_combinations(mapping: DataFrame) -> DataFrame:
    """Number of products with three and more ingredients, which the catalog does not hold."""
    return mapping.where("not is_monotherapy").groupBy("drug_concept_id").agg(F.count_distinct("ingredient_id").alias("n")).where("n > 2").agg(F.count("*").alias("n_ignored"))


def code_index(items: DataFrame, mapping: DataFrame, combination_codes: DataFrame) -> DataFrame:
    """(prescribed_concept_id, drug_id): products of single drugs, of combinations, and every drug its own code. Of several drugs with one code the later kind, then the larger id, stays."""
    own = items.select(F.col("drug_id").alias("prescribed_concept_id"), "drug_id", F.lit(0).alias("gen"))
    mono = mapping.where("is_monotherapy").join(items.select(F.col("drug_id").alias("ingredient_id")), "ingredient_id", "left_semi").select(F.col("drug_concept_id").alias("prescribed_concept_id"), F.col("ingredient_id").alias("drug_id"), F.lit(1).alias("gen"))
    combo = combination_codes.select("prescribed_concept_id", "drug_id", F.lit(2).alias("gen"))
    rows = own.unionByName(mono).unionByName(combo)
    return rows.groupBy("prescribed_concept_id").agg(F.max(F.struct("gen", "drug_id")).getField("drug_id").alias("drug_id"))


def observed_combinations(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Items of the given pairs (a, b), either order, that the catalog does not hold yet; an unknown ingredient is an error on evaluation."""
    norm = pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
    known = items.where(F.size("ingredient_concept_ids") == 2).select(F.element_at("ingredient_concept_ids", 1).alias("id_a"), F.element_at("ingredient_concept_ids", 2).alias("id_b"))
    fresh = norm.join(known, ["id_a", "id_b"], "left_anti")
    singles = items.where(F.size("ingredient_concept_ids") == 1)
    for side in ("id_a", "id_b"):
        fresh = fresh.join(singles.select(F.col("drug_id").alias(side), F.lit(True).alias("ok")), side, "left")
        fresh = fresh.withColumn(side, F.when(F.col("ok"), F.col(side)).otherwise(F.raise_error(F.concat(F.lit("unknown ingredient "), F.col(side).cast("string"))).cast("long"))).drop("ok")
    return _combined(fresh, singles, "de_facto_combination")


def lookup(items: DataFrame, index: DataFrame, codes: DataFrame) -> DataFrame:
    """Items of prescribed codes (column prescribed_concept_id); codes of no drug keep nulls."""
    return codes.join(index, "prescribed_concept_id", "left").join(items, "drug_id", "left")


def mapping_of_catalog(items: DataFrame, index: DataFrame) -> DataFrame:
    """(drug_concept_id, ingredient_id, is_monotherapy) of every code of the catalog, for studies that have no mapping of their own."""
    rows = index.join(items.select("drug_id", "kind"), "drug_id")
    return rows.select(F.col("prescribed_concept_id").alias("drug_concept_id"), F.col("drug_id").alias("ingredient_id"), (F.col("kind") == "monotherapy").alias("is_monotherapy")).distinct()


TARGET_LIST = "array<struct<uniprot_id:string,kd_nm:double,direction:int,potency_weight:double>>"


def targets_as_json(catalog: DataFrame) -> DataFrame:
    """The catalog with its list of targets as JSON text, nulls kept."""
    return catalog.withColumn("targets", F.to_json("targets", {"ignoreNullFields": "false"}))


def targets_from_json(catalog: DataFrame) -> DataFrame:
    """The catalog with its list of targets read from JSON text; unreadable text gives null."""
    return catalog.withColumn("targets", F.from_json("targets", TARGET_LIST))


def is_combination(items: DataFrame) -> DataFrame:
    return items.withColumn("is_combination", F.size("ingredient_concept_ids") > 1)


def catalog_audit(items: DataFrame, index: DataFrame) -> DataFrame:
    """(metric, value): sizes, vector coverage, dimensions, whether combinations add up to their parts, and codes of no item."""
    parts = items.where(F.size("ingredient_concept_ids") == 2).select(F.col("target_vector").alias("sum"), F.element_at("ingredient_concept_ids", 1).alias("id_a"), F.element_at("ingredient_concept_ids", 2).alias("id_b"))
    one = lambda s: items.select(F.col("drug_id").alias(f"id_{s}"), F.col("target_vector").alias(f"v_{s}"))
    gap = parts.join(one("a"), "id_a").join(one("b"), "id_b").select(V.norm(F.zip_with("sum", V.add(F.col("v_a"), F.col("v_b")), lambda x, y: x - y)).alias("gap"))
    counts = {
        "n_items": F.count("*"), "n_mono": F.count_if(F.col("kind") == "monotherapy"), "n_combinations": F.count_if(F.size("ingredient_concept_ids") > 1),
        "n_with_vector": F.count_if(V.any_nonzero(F.col("target_vector"))), "n_with_text": F.count("text_embedding"), "dim": F.max(F.size("target_vector")),
        "n_duplicate_ids": F.count("*") - F.count_distinct("drug_id"),
    }
    long = lambda df, named: df.agg(*[c.cast("double").alias(k) for k, c in named.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in named])).alias("x")).select("x.*")
    return (
        long(items, counts)
        .unionByName(long(gap, {"worst_additivity": F.coalesce(F.max("gap"), F.lit(0.0))}))
        .unionByName(long(index.join(items.select("drug_id"), "drug_id", "left_anti"), {"n_dangling_codes": F.count("*")}))
    )


def name_embeddings(names: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embedding of each name by exact lower-case, trimmed match; of several the smallest concept id; names without one keep null."""
    w = Window.partitionBy("key").orderBy("concept_id")
    have = embeddings.withColumn("key", F.lower(F.trim("concept_name"))).withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "concept_id", "dense_embedding")
    return names.withColumn("key", F.lower(F.trim("name"))).join(have, "key", "left").select("name", "concept_id", "dense_embedding")


def triplet_audit(triplets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, d_ab, d_ac, delta, passed) of triplets of names; null distances where a name has no embedding (untestable)."""
    e = embeddings.select(F.lower(F.trim("name")).alias("key"), F.col("dense_embedding").alias("v"))
    out = triplets
    for s in "abc":
        out = out.join(e.select(F.col("key").alias(f"k_{s}"), F.col("v").alias(f"v_{s}")), F.lower(F.trim(F.col(s))) == F.col(f"k_{s}"), "left")
    out = out.withColumn("d_ab", V.cosine_distance(F.col("v_a"), F.col("v_b"))).withColumn("d_ac", V.cosine_distance(F.col("v_a"), F.col("v_c")))
    return out.select("id", "d_ab", "d_ac", (F.col("d_ac") - F.col("d_ab")).alias("delta"), (F.col("d_ac") > F.col("d_ab")).alias("passed"))


def untestable(triplets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, n_missing) of triplets of which one name or more has no embedding."""
    keys = embeddings.select(F.lower(F.trim("name")).alias("key")).distinct()
    names = triplets.select("id", F.explode(F.array("a", "b", "c")).alias("name"))
    return names.join(keys, F.lower(F.trim("name")) == F.col("key"), "left_anti").groupBy("id").agg(F.count("*").alias("n_missing"))


def triplet_summary(audited: DataFrame) -> DataFrame:
    """One row over the rows of ``triplet_audit``: counts, win rate, mean, sd (n), median, t, signed-rank z and both p-values of delta."""
    one = audited.select(F.lit(1).alias("all"), "delta")
    counts = one.groupBy("all").agg(
        F.count("*").alias("n_triplets"), F.count("delta").alias("n_evaluated"), F.count_if(F.col("delta") > 0).alias("n_passed"),
        F.count_if(F.col("delta") > 0).cast("double").alias("wins"),
    )
    spread = stats.moments(one, ["all"], "delta").select("all", F.col("mean").alias("mean_delta"), F.col("sd_pop").alias("sd_delta"), F.col("median").alias("median_delta"), "t", F.col("n").alias("n_t"))
    ranks = stats.wilcoxon(one, ["all"], "delta").select("all", "z")
    out = counts.join(spread, "all", "left").join(ranks, "all", "left")
    return out.select(
        "n_triplets", "n_evaluated", "n_passed", F.when(F.col("n_evaluated") > 0, F.col("wins") / F.col("n_evaluated")).alias("win_rate"), "mean_delta", "sd_delta", "median_delta",
        "t", "z", stats.student_p("t", F.col("n_t") - 1).alias("p_t"), stats.normal_p("z").alias("p_wilcoxon"),
    )
