"""Measurements in different units, brought to the common unit of their biomarker.

A stated unit is read from the unit column or the text. A missing one is predicted by a calibrated forest from
the value's size, the source, the biomarker, the ranges in which the value is possible and what the source states
elsewhere. A confident prediction decides; the others get the unit the source states most often, corrected by
the possible range, and are marked for review.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortloom.session import cut, small, spread

# Rewriting of unit texts (lower case, without blanks and brackets) to one spelling.
SPELLINGS = [
    ("[µμ]", "u"), ("²", "2"), (",", "."), (r"[\s\[\]{}_·*^]", ""),
    ("milligrams?", "mg"), ("grams?", "g"), ("millimoles?", "mmol"), ("nanomoles?", "nmol"), ("moles?", "mol"),
    ("micro|mc(?=kat)", "u"), ("nano(?=kat)", "n"), ("decilit(?:re|er)", "dl"), ("lit(?:re|er)", "l"), ("per", "/"),
    ("/mn/", "/min/"), ("/sec", "/s"), ("kilopascals?", "kpa"), ("mmofmercury|mm-hg", "mmhg"), ("^%(?:ngsp|dcct|\\(dcct\\)|ofhb)$", "%"),
    ("^(?:pct|/cent)$", "%"), ("^(?:mg%|mg/100ml)$", "mg/dl"), ("^mm$", "mmol/l"), ("^nm$", "nmol/l"),
    ("^mmol/mol(?:hb|ifcc)$", "mmol/mol"), ("^(?:hbfraction|l/l|proportion|ratio)$", "fraction"), ("^(?:iu|ui|units?)/l$", "u/l"),
]

NUMBER = r"(?<![\w/{.,])(?<!per )([-+]?\d+(?:[.,]\d+)?)"


_KEYS: dict[str, str | None] = {}


def spelling(text: str) -> str | None:
    """One spelling of a unit text, to be compared with the unit codes in the same spelling; None for a blank one."""
    out = text.lower()
    for pattern, by in SPELLINGS:
        out = re.sub(pattern, by, out)
    return out or None


@F.pandas_udf(StringType())
def unit_key(text: pd.Series) -> pd.Series:
    """``spelling`` of each text; the texts of units are few, and each is worked out once a process."""
    codes, texts = pd.factorize(text)
    if len(_KEYS) > 200_000:
        _KEYS.clear()
    for t in texts:
        if t not in _KEYS:
            _KEYS[t] = spelling(t)
    return pd.Series([None if c < 0 else _KEYS[texts[c]] for c in codes], dtype=object)


def _bare(text: Column) -> Column:
    """The text without names of tests that hold digits."""
    return F.regexp_replace(text, r"(?i)\b(?:hb)?a1c\b", "")


def number_in(text: Column) -> Column:
    found = F.regexp_extract(_bare(text), NUMBER, 1)
    return F.when(found != "", F.regexp_replace(found, ",", ".").try_cast("double"))


def unit_in(text: Column) -> Column:
    """The unit text stated in a free text: after 'unit=', 'reported in', the number, or inside the last brackets."""
    tries = [(text, r"unit\s*[=:]\s*(.+)$"), (text, r"(?i)reported in\s+(.+)$"), (_bare(text), NUMBER + r"\s*(\D.*)$"), (text, r"\[(.+)\]\s*$")]
    return F.coalesce(*[F.when(F.regexp_extract(t, p, p.count("(") - p.count("(?")) != "", F.regexp_extract(t, p, p.count("(") - p.count("(?"))) for t, p in tries])


def unit_book(codebook: DataFrame, reference: DataFrame) -> DataFrame:
    """Per concept: biomarker, possible range and the units of the biomarker in a fixed order."""
    units = reference.withColumn("key", unit_key(F.col("unit_code"))).groupBy("biomarker").agg(
        F.sort_array(F.collect_list(F.struct("unit_code", "factor", "shift", "is_common", "key"))).alias("units")
    )
    # cut, so that the keys are not worked out again for every measurement
    return cut(codebook.select("concept_id", "biomarker", "lo", "hi").join(units, "biomarker", "left").withColumnRenamed("concept_id", "measurement_concept_id"))


def stated_units(meas: DataFrame, book: DataFrame) -> DataFrame:
    """Rows with a concept of the book and a number: id, concept, source, value, slot of the stated unit (or null) and its origin."""
    number = F.coalesce(F.when(~F.isnan("val"), F.col("val")), number_in(F.col("value_text")))
    read = spread(meas.select("measurement_id", "measurement_concept_id", "val", "unit_text", "value_text", "site_id")).select(
        "measurement_id", "measurement_concept_id", "site_id", number.alias("value"), F.col("unit_text").alias("text1"), unit_in(F.col("value_text")).alias("text2")
    )

    def slot(key: str) -> Column:
        at = F.array_position(F.col("units.key"), F.col(key))
        return F.when(at > 0, at.cast("int") - 1)

    return (
        read.where("value is not null")
        .join(small(book.select("measurement_concept_id", "units")), "measurement_concept_id")
        .withColumn("k1", unit_key(F.col("text1"))).withColumn("k2", unit_key(F.col("text2")))
        .withColumn("s1", slot("k1")).withColumn("s2", slot("k2"))
        .select(
            "measurement_id", "measurement_concept_id", "site_id", "value", F.coalesce("s1", "s2").alias("stated"),
            F.when(F.col("s1").isNotNull(), "unit_text").when(F.col("s2").isNotNull(), "value_text").alias("origin"),
        )
    )


def possible_in(i: Column) -> Column:
    u = F.get("units", i)
    return (F.col("value") * u["factor"] + u["shift"]).between(F.col("lo"), F.col("hi"))


def settle(slot: Column) -> Column:
    """The slot of the unit, after the check of the possible range."""
    n = F.size("units")
    fits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i != slot) & possible_in(i))
    return F.when(possible_in(slot) | (F.size(fits) != 1), slot).otherwise(F.get(fits, F.lit(0)))


def site_habits(stated: DataFrame) -> DataFrame:
    """Per source and biomarker: the unit stated most often (ties: the smaller code) and each unit's share."""
    counts = stated.where("stated is not null").groupBy("site_id", "biomarker", "stated").count()
    return (
        counts.groupBy("site_id", "biomarker")
        .agg(
            F.min(F.struct((-F.col("count")).alias("n"), F.col("stated").alias("slot"))).getField("slot").alias("usual"),
            F.sum("count").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("stated", "count"))).alias("by_slot"),
        )
    )


def _features(df: DataFrame, width: int, biomarkers: list[str]) -> DataFrame:
    lit0 = F.lit(0.0)
    cols = {"f_size": F.coalesce(F.when(F.col("value") > 0, F.log10("value")), F.lit(-9.0)), "f_kind": F.coalesce(F.array_position(F.array(*[F.lit(b) for b in biomarkers]), F.col("biomarker")).cast("double"), lit0)}
    usual = F.coalesce(settle(F.coalesce("usual", "common")).cast("double"), F.lit(-1.0))
    for i in range(width):
        cols[f"f_habit{i}"] = (usual == i).cast("double")
        cols[f"f_share{i}"] = F.coalesce(F.try_element_at("by_slot", F.lit(i)) / F.col("total"), lit0)
        cols[f"f_fits{i}"] = F.coalesce(F.when(F.size("units") > i, possible_in(F.lit(i)).cast("double")), F.lit(-1.0))
    cols["f_usual"] = F.coalesce(F.col("usual").cast("double"), F.lit(-1.0))
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df.withColumns(cols)).drop(*cols)


class UnitForest:
    """Random forest over unit slots, with confidences calibrated on held-out labelled rows."""

    def __init__(self, model, width: int, biomarkers: list[str], steps: list[tuple[float, float]]):
        self.model, self.width, self.biomarkers, self.steps = model, width, biomarkers, steps

    @classmethod
    def fit(cls, labelled: DataFrame, *, sample_rows: int = 12_000, trees: int = 20, depth: int = 7, seed: int = 7) -> UnitForest | None:
        """Fit on a bounded sample of rows whose unit is stated: at most about ``sample_rows``, drawn by hash of the id.

        The label is the stated unit after the check of the possible range. None if no unit is stated.
        """
        n = labelled.count()
        if not n:
            return None
        keep = min(1.0, sample_rows / n)
        draw = F.pmod(F.xxhash64("measurement_id", F.lit(seed)), F.lit(1 << 40))
        rows = labelled.where(draw < int(keep * (1 << 40)) + 1).withColumn("label", settle(F.col("stated")).cast("double")).withColumn("held", draw % 4 == 0)
        shape = rows.agg(F.max(F.size("units")).alias("w"), F.sort_array(F.collect_set("biomarker")).alias("b")).first()
        if not shape["w"]:
            return None
        rows = cut(_features(rows, shape["w"], shape["b"]).select("features", "label", "held").coalesce(4))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32)
        train, held = rows.where("not held"), rows.where("held")
        if not train.take(1):
            train = held = rows
        model = forest.fit(train)
        # calibration: hit rate by band of the raw top vote, made monotone by pooling neighbours
        scored = model.transform(held).select(F.array_max(vector_to_array("probability")).alias("p"), (F.col("prediction") == F.col("label")).cast("double").alias("hit"))
        bands = scored.groupBy(F.floor(F.col("p") * 50).alias("band")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).orderBy("band").collect()
        pooled: list[list[float]] = []
        for b in bands:
            pooled.append([b["band"] / 50, b["n"], b["hits"]])
            while len(pooled) > 1 and pooled[-2][2] / pooled[-2][1] > pooled[-1][2] / pooled[-1][1]:
                last = pooled.pop()
                pooled[-1][1] += last[1]
                pooled[-1][2] += last[2]
        steps = [(low, hits / m) for low, m, hits in pooled]
        return cls(model, shape["w"], shape["b"], steps)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds guess (slot) and confidence (calibrated probability that it is right)."""
        p = F.array_max(vector_to_array("probability"))
        sure = F.lit(0.0)
        for low, rate in self.steps:
            sure = F.when(p >= low, F.lit(rate)).otherwise(sure)
        out = self.model.transform(_features(df, self.width, self.biomarkers))
        return out.withColumn("guess", F.col("prediction").cast("int")).withColumn("confidence", sure).drop("features", "rawPrediction", "probability", "prediction")


def _with_habits(spark: SparkSession, meas: DataFrame, codebook: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of ``stated_units`` with their biomarker's range and units, the habits of their source and the common unit's slot."""
    book = unit_book(codebook, reference)
    rows = cut(stated_units(meas, book)).join(small(book), "measurement_concept_id")
    keyed = small(cut(site_habits(rows)).withColumnsRenamed({"site_id": "h_site", "biomarker": "h_bio"}))
    rows = rows.alias("m").join(keyed, F.col("m.site_id").eqNullSafe(F.col("h_site")) & (F.col("m.biomarker") == F.col("h_bio")), "left").drop("h_site", "h_bio")
    common = F.filter(F.sequence(F.lit(0), F.size("units") - 1), lambda i: F.get("units", i)["is_common"])
    return rows.withColumn("common", F.get(common, F.lit(0)))


def convert_units(spark: SparkSession, meas: DataFrame, codebook: DataFrame, reference: DataFrame, *, confident: float = 0.9, sample_rows: int = 12_000) -> DataFrame:
    """One row per measurement with a codebook concept and a number, in its own and the common unit.

    Columns: measurement_id, biomarker, site_id, value, unit_code, unit_origin ('unit_text', 'value_text',
    'forest', 'site'), confidence (null where stated), common_unit, common_value, needs_review.
    A stated unit wins; where none is stated and the forest is ``confident``, its unit is taken ('forest'); the others
    get the source's usual unit after the check of the possible range ('site') and need review, and so do stated units
    that the range corrects. A biomarker without units keeps a null unit and value and needs review.
    Null or NaN values without a number in the text, null and foreign concepts give no row. A null site is a
    source of its own. Repeated rows give repeated results; empty tables an empty result.
    """
    rows = _with_habits(spark, meas, codebook, reference)
    told = rows.where("stated is not null")
    silent = rows.where("stated is null")
    forest = UnitForest.fit(told, sample_rows=sample_rows)
    silent = forest.predict(silent) if forest else silent.withColumn("guess", F.lit(None).cast("int")).withColumn("confidence", F.lit(0.0))
    sure = F.coalesce((F.col("confidence") >= confident) & (F.col("guess") < F.size("units")), F.lit(False))
    silent = silent.withColumn("sure", sure).withColumn("slot", F.when(F.col("sure"), F.col("guess")).otherwise(settle(F.coalesce("usual", "common"))))
    silent = silent.withColumn("origin", F.when(F.col("sure"), "forest").otherwise("site")).withColumn("needs_review", ~F.col("sure"))
    told = told.withColumn("slot", settle(F.col("stated"))).withColumn("confidence", F.lit(None).cast("double")).withColumn("needs_review", F.col("slot") != F.col("stated"))
    keep = ["measurement_id", "biomarker", "site_id", "value", "units", "slot", "common", "origin", "confidence", "needs_review"]
    unit = F.get("units", F.col("slot"))
    return told.select(*keep).unionByName(silent.select(*keep)).select(
        "measurement_id", "biomarker", "site_id", "value", unit["unit_code"].alias("unit_code"), F.col("origin").alias("unit_origin"), "confidence",
        F.get("units", F.col("common"))["unit_code"].alias("common_unit"), (F.col("value") * unit["factor"] + unit["shift"]).alias("common_value"),
        (F.coalesce("needs_review", F.lit(True)) | F.col("slot").isNull()).alias("needs_review"),
    )
