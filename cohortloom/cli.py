"""Command line: python -m cohortloom.cli STAGE ROOT [options]. Stages read and write Parquet tables under ROOT.

Inputs, under ROOT/raw: observation_period, drug_exposure and measurement as CSV shards, concept and concept_ancestor, mechanisms, affinities,
protein_vectors (uniprot_id, vp) and text_embeddings as Parquet. Every stage needs only the tables of stages before it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.config import Paths, Protocol, biomarker_codebook
from cohortloom.operators import audit, cache, catalog, cohorts, features, outcomes, pairs, representations, targets, vocabulary
from cohortloom.sources import files, readers, writers
from cohortloom.sources.files import join

OBSERVATION = ("person_id", "observation_period_start_date", "observation_period_end_date")
EXPOSURE = ("person_id", "drug_concept_id", "drug_exposure_start_date", "drug_exposure_end_date", "days_supply")
MEASUREMENT = ("person_id", "measurement_date", "measurement_concept_id", "value_as_number")


class Study:
    def __init__(self, spark: SparkSession, paths: Paths, protocol: Protocol = Protocol()):
        self.spark, self.paths, self.protocol = spark, paths, protocol

    def raw(self, name: str) -> str:
        return join(self.paths.root, "raw", name)

    def table(self, path: str) -> DataFrame:
        readers.require(self.spark, path)
        return self.spark.read.parquet(path)

    def mapping(self) -> None:
        concept, ancestor = (self.spark.read.parquet(self.raw(n)) for n in ("concept", "concept_ancestor"))
        writers.parquet(vocabulary.product_mapping(ancestor, vocabulary.ingredients(concept)), self.paths.mapping)

    def catalog_mapping(self) -> None:
        """The mapping from the catalog's own codes, where there is a catalog and no mapping."""
        if not files.exists(self.spark, self.paths.mapping) and files.exists(self.spark, self.paths.catalog):
            items, codes = self.table(join(self.paths.catalog, "items")), self.table(join(self.paths.catalog, "codes"))
            writers.parquet(catalog.mapping_of_catalog(items, codes), self.paths.mapping)

    def cache(self, ratio: float = 1.0) -> None:
        self.catalog_mapping()
        writers.parquet(cache.trim_observation(readers.tolerant_csv(self.spark, self.raw("observation_period"), *OBSERVATION), ratio), self.paths.observation_period)
        exposure = cache.trim_exposure(readers.tolerant_csv(self.spark, self.raw("drug_exposure"), *EXPOSURE), self.table(self.paths.mapping), self.table(self.paths.observation_period))
        writers.parquet(exposure, self.paths.drug_exposure)
        writers.parquet(cache.trim_measurement(readers.tolerant_csv(self.spark, self.raw("measurement"), *MEASUREMENT), biomarker_codebook(self.spark)), self.paths.measurement)

    def features(self, min_score: int = 400, components: int = 128) -> None:
        """Protein vectors from the language model's table, reactome.tsv, string_links.txt.gz, string_aliases.tsv.gz, gtex.gct.gz and the protein vocabulary."""
        lm = self.spark.read.parquet(self.raw("lm_embeddings"))
        proteins = lm.select("uniprot_id")
        path = features.pathway_embeddings(readers.reactome(self.spark, self.raw("reactome.tsv")), proteins, components)
        links = features.interaction_embeddings(readers.string_links(self.spark, self.raw("string_links.txt.gz")), readers.string_aliases(self.spark, self.raw("string_aliases.tsv.gz")), proteins, components, min_score)
        tpm, tissues = readers.gct(self.spark, self.raw("gtex.gct.gz"))
        expression = features.expression_embeddings(tpm, self.spark.read.parquet(self.raw("protein_vocabulary")), proteins, len(tissues))
        writers.parquet(features.assembled_vectors(lm, path, links, expression), join(self.paths.root, "protein_vectors"))

    def catalog(self, cutoff: float = 10_000.0) -> None:
        concept, mech, aff, text = (self.spark.read.parquet(self.raw(n)) for n in ("concept", "mechanisms", "affinities", "text_embeddings"))
        vp = self.spark.read.parquet(readers.first_existing(self.spark, self.paths.root, "protein_vectors", "raw/protein_vectors") or self.raw("protein_vectors"))
        drugs = vocabulary.ingredients(concept, standard=True)
        dim = vp.agg(F.max(F.size("vp"))).first()[0] or 0
        base = targets.theoretical_catalog(drugs, targets.drug_targets(drugs, mech, aff), vp, dim=dim, cutoff=cutoff)
        singles = catalog.single_items(catalog.merge_text_embeddings(base, text))
        mapping = self.table(self.paths.mapping)
        combos, codes = catalog.fixed_combinations(mapping, singles)
        writers.parquet(singles.unionByName(combos), join(self.paths.catalog, "items"))
        writers.parquet(catalog.code_index(singles, mapping, codes), join(self.paths.catalog, "codes"))

    def cohorts(self, resume: bool = True, limit: int | None = None) -> None:
        items = self.table(join(self.paths.catalog, "items")).where(F.size("ingredient_concept_ids") == 1).select("drug_id", "name")
        manifest_path = join(self.paths.cohorts, "manifest")
        old = self.spark.read.parquet(manifest_path) if resume and readers.first_existing(self.spark, self.paths.cohorts, "manifest") else None
        queue = cohorts.remaining(items, old, limit) if old is not None else (items if limit is None else items.orderBy("drug_id").limit(limit))
        steps = cohorts.screen(self.table(self.paths.drug_exposure), self.table(self.paths.observation_period), self.protocol)
        mode = "append" if old is not None else "overwrite"
        index = cohorts.mono_cohorts(steps).join(queue.select("drug_id"), "drug_id", "left_semi")
        writers.parquet(index, join(self.paths.cohorts, "index"), partition="drug_id", mode=mode)
        writers.parquet(cohorts.pair_cohorts(cohorts.pair_members(steps), items, self.protocol.least_pair_size), join(self.paths.cohorts, "pairs"), partition="pair_id")
        writers.parquet(cohorts.attrition(steps), join(self.paths.cohorts, "attrition"))
        new = cohorts.manifest(index, queue)
        writers.replace(self.spark, cohorts.upsert_manifest(old, new) if old is not None else new, manifest_path)

    def outcomes(self, least: int = 1) -> None:
        big = self.table(join(self.paths.cohorts, "manifest")).where((F.col("status") == "SAVED") & (F.col("n_final") >= least)).select("drug_id")
        index = self.table(join(self.paths.cohorts, "index")).join(big, "drug_id", "left_semi")
        out = outcomes.windowed_outcomes(index, outcomes.plausible(self.table(self.paths.measurement), biomarker_codebook(self.spark)))
        writers.parquet(out, join(self.paths.cohorts, "outcomes"), partition="drug_id")
        writers.parquet(outcomes.outcome_summary(self.table(join(self.paths.cohorts, "outcomes"))), join(self.paths.cohorts, "outcome_summary"))

    def passes(self) -> None:
        done = self.table(join(self.paths.cohorts, "representations")) if readers.first_existing(self.spark, self.paths.cohorts, "representations") else None
        writers.parquet(representations.remaining_passes(self.table(join(self.paths.cohorts, "index")), done), join(self.paths.cohorts, "passes"), partition="pass_id")

    def dispatch(self) -> None:
        """Representations that a model wrote for a pass (raw/representations/pass_id=N: patient_id and feature columns) given back to cohorts and merged."""
        passes = self.table(join(self.paths.cohorts, "passes"))
        target = join(self.paths.cohorts, "representations")
        given = self.spark.read.parquet(self.raw("representations"))
        new = representations.dispatch_all(passes, given)
        old = self.table(target) if files.exists(self.spark, target) else None
        writers.replace(self.spark, new if old is None else representations.merged(old, new), target)

    def pairs(self) -> None:
        reps, index = self.table(join(self.paths.cohorts, "representations")), self.table(join(self.paths.cohorts, "index"))
        points = representations.aligned(index.select("drug_id", "person_id", "t0"), reps.drop("drug_id").dropDuplicates(["person_id", "t0"]))
        names = self.table(join(self.paths.catalog, "items")).select("drug_id", "name")
        writers.parquet(pairs.candidate_pairs(points, index, names), join(self.paths.cohorts, "candidate_pairs"))

    def audit(self) -> None:
        index, exposure = self.table(join(self.paths.cohorts, "index")), self.table(self.paths.drug_exposure)
        observation, manifest = self.table(self.paths.observation_period), self.table(join(self.paths.cohorts, "manifest"))
        reports = {
            "manifest": audit.manifest_matches(index, manifest), "duplicates": audit.duplicate_persons(index), "windows": audit.window_violations(index, observation, self.protocol),
            "washout": audit.washout_leaks(index, exposure, protocol=self.protocol), "coinitiations": audit.coinitiations(index, exposure, self.protocol), "calendar": audit.calendar_summary(index),
        }
        person = readers.person_table(self.spark, join(self.paths.root, "raw"))
        if person is not None:
            reports["demographics"] = audit.demographics(index, person)
        for name, df in reports.items():
            writers.parquet(df, join(self.paths.cohorts, "audit", name))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=["mapping", "cache", "features", "catalog", "cohorts", "outcomes", "passes", "dispatch", "pairs", "audit", "all"])
    p.add_argument("root")
    p.add_argument("--ratio", type=float, default=1.0, help="share of persons in the cache")
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--min-n", type=int, default=1)
    p.add_argument("--cutoff", type=float, default=10_000.0, help="largest affinity in nM that counts")
    a = p.parse_args(argv)
    study = Study(SparkSession.builder.appName("cohortloom").getOrCreate(), Paths(a.root, sampled=a.ratio < 1.0))
    steps = {
        "mapping": study.mapping, "cache": lambda: study.cache(a.ratio), "features": study.features, "catalog": lambda: study.catalog(a.cutoff), "cohorts": lambda: study.cohorts(not a.no_resume, a.limit),
        "outcomes": lambda: study.outcomes(a.min_n), "passes": study.passes, "dispatch": study.dispatch, "pairs": study.pairs, "audit": study.audit,
    }
    if a.stage != "all":
        return steps[a.stage]()
    # stages whose inputs come from models outside run where these inputs lie ready
    needs = {"features": study.raw("lm_embeddings"), "dispatch": study.raw("representations"), "pairs": join(study.paths.cohorts, "representations")}
    for name, step in steps.items():
        if name in needs and not files.exists(study.spark, needs[name]):
            print(f"skipped {name}: {needs[name]} is missing")
            continue
        step()


if __name__ == "__main__":
    main()
