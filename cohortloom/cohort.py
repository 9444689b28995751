"""One cohort as an object over DataFrames: its members, outcomes and representations, aligned by key."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import pairs, representations
from cohortloom.sources import files, readers, writers

ARTEFACTS = ("index", "outcomes", "representations", "deltas", "prototypes", "draws", "proteins")


@dataclass(frozen=True)
class Cohort:
    """``index`` has person_id, t0 and the other index columns; the rest is optional."""

    drug_id: int
    name: str = ""
    kind: str = "monotherapy"
    ingredient_concept_ids: tuple[int, ...] = field(default=())
    index: DataFrame | None = None
    outcomes: DataFrame | None = None
    representations: DataFrame | None = None
    deltas: DataFrame | None = None
    prototypes: DataFrame | None = None
    draws: DataFrame | None = None
    proteins: DataFrame | None = None

    def __post_init__(self):
        if not self.ingredient_concept_ids and self.drug_id > 0:
            object.__setattr__(self, "ingredient_concept_ids", (self.drug_id,))

    @classmethod
    def of_item(cls, item, **artefacts: DataFrame) -> Cohort:
        """From a row of the catalog."""
        return cls(item["drug_id"], item["name"], item["kind"], tuple(item["ingredient_concept_ids"] or ()), **artefacts)

    def _members(self) -> DataFrame:
        if self.index is None:
            raise ValueError(f"cohort {self.drug_id} has no index")
        return self.index

    @property
    def n_patients(self) -> int:
        return self._members().count()

    @property
    def n_with_12m(self) -> int:
        return self._members().where("has_12m_followup").count()

    def with_features(self, name: str, features: DataFrame, keys: tuple[str, ...] = ("person_id", "t0")) -> Cohort:
        """A copy with ``features`` (key columns and one column per feature) as an aligned array; members without features are left out."""
        return replace(self, **{name: representations.aligned(self._members().select(*keys), features, list(keys))})

    def with_prototypes(self, k: int = 3) -> Cohort:
        if self.representations is None or not self.representations.take(1):
            raise ValueError(f"cohort {self.drug_id} has no representations")
        points = self.representations.select(F.lit(self.drug_id).cast("long").alias("drug_id"), "person_id", "vec")
        return replace(self, prototypes=pairs.prototypes(points, k).select("k_id", "proto"))

    def distance(self, other: Cohort) -> float:
        """Smallest cosine distance of any two prototypes."""
        both = [c.prototypes.select(F.lit(i).cast("long").alias("drug_id"), "proto") for i, c in enumerate((self, other))]
        return pairs.cohort_distances(both[0].unionByName(both[1])).first()["distance"]

    def prediction_times(self, timepoint: str = "t0", source: str = "index") -> DataFrame:
        """Times of the members, or, for ``source`` 'draws', of the persons with a blood draw."""
        if source not in ("index", "draws"):
            raise ValueError(f"unknown source {source!r}")
        if source == "draws":
            return representations.prediction_times(self._drawn(), "t0", "eid")
        return representations.prediction_times(self._members(), timepoint)

    def _drawn(self) -> DataFrame:
        if self.draws is None:
            raise ValueError(f"cohort {self.drug_id} has no blood draws")
        return self.draws

    def with_proteins(self, measured: DataFrame) -> Cohort:
        """A copy with the measured proteins (eid and one column each) of the persons with a blood draw as an aligned array."""
        return replace(self, proteins=representations.aligned(self._drawn().select("eid"), measured, ["eid"]))

    def save(self, path: str) -> None:
        tables = {a: getattr(self, a) for a in ARTEFACTS if getattr(self, a) is not None}
        writers.cohort(SparkSession.active(), path, {"drug_id": self.drug_id, "name": self.name, "kind": self.kind, "ingredient_concept_ids": list(self.ingredient_concept_ids)}, **tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cohort:
        """From a saved folder; artefacts that are not there stay None."""
        meta = readers.metadata(spark, path)
        tables = {a: spark.read.parquet(files.join(path, a)) for a in ARTEFACTS if files.is_folder(spark, files.join(path, a))}
        return cls(meta["drug_id"], meta["name"], meta["kind"], tuple(meta["ingredient_concept_ids"]), **tables)
