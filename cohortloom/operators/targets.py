"""Drug targets: mechanisms matched to ingredients, best affinity each, and signed, potency-weighted target vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import text as T
from cohortloom.functions import vectors as V


def best_affinity_per_type(affinities: DataFrame) -> DataFrame:
    """One row per (drug_chembl_id, uniprot_id): the most trusted type, then the smallest value; a null value comes before numbers of its type."""
    ranked = affinities.where("drug_chembl_id is not null and uniprot_id is not null").withColumn("priority", T.affinity_priority(F.col("standard_type")))
    order = Window.partitionBy("drug_chembl_id", "uniprot_id").orderBy("priority", F.col("min_affinity_nm").asc_nulls_first(), "standard_type")
    return ranked.withColumn("r", F.row_number().over(order)).where("r = 1").select("drug_chembl_id", "uniprot_id", "standard_type", "min_affinity_nm")


def drug_targets(ingredients: DataFrame, mechanisms: DataFrame, affinities: DataFrame) -> DataFrame:
    """Best row per (concept_id, uniprot_id) of mechanisms whose normalised name is an ingredient's name.

    Ties of equal affinity go to the smaller supplier id, action and mechanism; nulls come last.
    """
    named = mechanisms.withColumn("match_name", T.normalized_name(F.col("drug_name"))).where("match_name != '' and drug_name is not null")
    named = named.withColumn("direction", T.effect_direction(F.col("action_type"), F.col("mechanism_of_action")))
    listed = ingredients.select("concept_id", "concept_name", F.lower("concept_name").alias("match_name"))
    rows = named.join(listed, "match_name").join(best_affinity_per_type(affinities), ["drug_chembl_id", "uniprot_id"], "left")
    order = Window.partitionBy("concept_id", "uniprot_id").orderBy(*[F.col(c).asc_nulls_last() for c in ("min_affinity_nm", "drug_chembl_id", "action_type", "mechanism_of_action")])
    cols = ["concept_id", "concept_name", "drug_chembl_id", "uniprot_id", "action_type", "mechanism_of_action", "direction", "standard_type", "min_affinity_nm"]
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select(*cols)


def weighted_targets(targets: DataFrame, cutoff: float = 10_000.0, default: float = 100.0) -> DataFrame:
    """Targets with potency score, effective sign and weight within the drug; those of score 0 fall away."""
    scored = targets.withColumn("score", T.potency_score(F.col("min_affinity_nm"), cutoff, default)).where("score > 0")
    sign = T.effective_direction(T.resolved_direction(F.col("direction"), F.col("action_type")))
    return scored.withColumn("sigma", sign).withColumn("weight", F.col("score") / F.sum("score").over(Window.partitionBy("concept_id")))


def theoretical_catalog(ingredients: DataFrame, targets: DataFrame, vectors: DataFrame, *, dim: int, cutoff: float = 10_000.0, default: float = 100.0) -> DataFrame:
    """One row per ingredient: targets, mechanisms and the vector sum of weight * sign * target vector; the zero vector where no target is left.

    ``vectors`` has uniprot_id and vp (array of ``dim``). Isoforms of a protein count apart in n_targets and weights. Targets
    without a vector do not count. Sums are double, the result is float.
    """
    keyed = targets.withColumn("acc", T.protein_accession(F.col("uniprot_id")))
    usable = weighted_targets(keyed.join(vectors.select(F.col("uniprot_id").alias("acc")), "acc", "left_semi"), cutoff, default)
    # one row a target, whose scaled vectors are added map-side
    parts = usable.join(vectors.select(F.col("uniprot_id").alias("acc"), "vp"), "acc").select(
        "concept_id", array_to_vector(F.transform("vp", lambda x: x.cast("double") * F.col("weight") * F.col("sigma"))).alias("part")
    )
    ua = parts.groupBy("concept_id").agg(vector_to_array(Summarizer.sum(F.col("part"))).cast("array<float>").alias("ua"))
    info = usable.groupBy("concept_id").agg(
        F.min("drug_chembl_id").alias("chembl_id"), F.count("*").alias("n_targets"), F.sort_array(F.collect_set("acc")).alias("target_uids"),
        F.sort_array(F.collect_set("mechanism_of_action")).alias("mechanisms"),
        F.sort_array(F.collect_list(F.struct("uniprot_id", F.col("min_affinity_nm").alias("kd_nm"), F.col("sigma").cast("int").alias("direction"), F.col("weight").alias("potency_weight")))).alias("targets"),
    )
    out = ingredients.select(F.col("concept_id").alias("ingredient_concept_id"), F.col("concept_name").alias("ingredient_name")).join(info.join(ua, "concept_id").withColumnRenamed("concept_id", "ingredient_concept_id"), "ingredient_concept_id", "left")
    return out.withColumns(
        {
            "n_targets": F.coalesce("n_targets", F.lit(0).cast("long")), "target_uids": F.coalesce("target_uids", F.array().cast("array<string>")), "mechanisms": F.coalesce("mechanisms", F.array().cast("array<string>")),
            "targets": F.coalesce("targets", F.array().cast("array<struct<uniprot_id:string,kd_nm:double,direction:int,potency_weight:double>>")),
            "ua": F.coalesce("ua", F.array_repeat(F.lit(0.0).cast("float"), dim)),
        }
    )


def eliminated_targets(targets: DataFrame, cutoff: float = 10_000.0) -> DataFrame:
    """How many targets the cutoff removes, per drug."""
    return targets.groupBy("concept_id").agg(F.count("*").alias("n_all"), F.count_if(F.col("min_affinity_nm") > cutoff).alias("n_eliminated"))


def catalog_coverage(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("n_drugs"), F.count_if(F.col("n_targets") > 0).alias("n_with_targets"), F.count_if(V.any_nonzero(F.col("ua"))).alias("n_with_vector"))
