"""Protocol parameters and paths of a study."""

from __future__ import annotations

from dataclasses import dataclass

from cohortloom.sources.files import join


@dataclass(frozen=True)
class Protocol:
    """Windows of the target-trial protocol, in days, and the least size of a two-drug cohort."""

    history_days: int = 365
    follow_up_days: int = 182
    full_follow_up_days: int = 365
    washout_days: int = 365
    least_pair_size: int = 50


@dataclass(frozen=True)
class Screening:
    """Parameters of the screening of cohort pairs."""

    prototypes: int = 3
    least_patients: int = 50
    max_distance: float = 0.35
    neighbours: int = 10
    mutual: bool = False


@dataclass(frozen=True)
class Paths:
    """Where a study keeps its tables, on any file system; a sampled cache lives apart from the full one."""

    root: str
    sampled: bool = False

    @property
    def cache(self) -> str:
        return join(self.root, "cache_sample" if self.sampled else "cache_full")

    @property
    def drug_exposure(self) -> str:
        return join(self.cache, "drug_exposure")

    @property
    def observation_period(self) -> str:
        return join(self.cache, "observation_period")

    @property
    def measurement(self) -> str:
        return join(self.cache, "measurement")

    @property
    def mapping(self) -> str:
        return join(self.root, "mapping")

    @property
    def catalog(self) -> str:
        return join(self.root, "catalog")

    @property
    def cohorts(self) -> str:
        return join(self.root, "cohorts")


# Concept ids and possible ranges of the six biomarkers.
BIOMARKERS = {
    "ldl": ((3028288, 3027597), 10.0, 400.0),
    "hba1c": ((3004410, 3005673, 40762352), 3.0, 20.0),
    "egfr": ((3049187, 3053283, 3030354, 40764999), 3.0, 180.0),
    "alt": ((3006923, 3000676), 2.0, 2000.0),
    "crp": ((3020460, 3010156, 3007461), 0.05, 300.0),
    "sbp": ((3004249,), 60.0, 260.0),
}


def biomarker_codebook(spark):
    """The default codebook as a DataFrame (concept_id, biomarker, lo, hi)."""
    rows = [(c, b, lo, hi) for b, (ids, lo, hi) in BIOMARKERS.items() for c in ids]
    return spark.createDataFrame(rows, "concept_id long, biomarker string, lo double, hi double")
