"""Mapping of ingredients to prescribable products, from the vocabulary's ancestor table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingredients(concept: DataFrame, *, vocabulary: str | None = "RxNorm", standard: bool = False) -> DataFrame:
    """Ingredient concepts (concept_id, concept_name); vocabulary and standard flag are optional conditions."""
    cond = F.col("concept_class_id") == "Ingredient"
    if vocabulary:
        cond &= F.col("vocabulary_id") == vocabulary
    if standard:
        cond &= F.col("standard_concept") == "S"
    return concept.where(cond).select("concept_id", "concept_name")


def product_mapping(ancestor: DataFrame, ingredient: DataFrame) -> DataFrame:
    """(ingredient_id, drug_concept_id, is_monotherapy): one row per ingredient of a product; mono = exactly one distinct ingredient."""
    rows = (
        ancestor.join(ingredient.select(F.col("concept_id").alias("ancestor_concept_id")), "ancestor_concept_id", "left_semi")
        .select(F.col("ancestor_concept_id").cast("long").alias("ingredient_id"), F.col("descendant_concept_id").cast("long").alias("drug_concept_id"))
        .distinct()
    )
    count = rows.groupBy("drug_concept_id").agg((F.count("ingredient_id") == 1).alias("is_monotherapy"))
    return rows.join(count, "drug_concept_id").select("ingredient_id", "drug_concept_id", "is_monotherapy")


def catalog_mapping(ancestor: DataFrame, concept: DataFrame, catalog: DataFrame) -> DataFrame:
    """Products of the catalog's ingredients only, counted over all standard ingredients, plus each ingredient as its own mono product; sorted."""
    standard = ingredients(concept, vocabulary=None, standard=True)
    full = product_mapping(ancestor.where(F.col("ancestor_concept_id") != F.col("descendant_concept_id")), standard)
    wanted = catalog.select(F.col("ingredient_id").cast("long").alias("ingredient_id")).distinct()
    own = wanted.select("ingredient_id", F.col("ingredient_id").alias("drug_concept_id"), F.lit(True).alias("is_monotherapy"))
    both = full.join(wanted, "ingredient_id", "left_semi").unionByName(own)
    return both.groupBy("ingredient_id", "drug_concept_id").agg(F.bool_or("is_monotherapy").alias("is_monotherapy")).orderBy("ingredient_id", "drug_concept_id")


def mapping_summary(mapping: DataFrame) -> DataFrame:
    return mapping.agg(F.count("*").alias("n_rows"), F.count_distinct("ingredient_id").alias("n_ingredients"), F.count_if("is_monotherapy").alias("n_mono"))
