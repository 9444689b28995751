"""Readers, writers, the incremental ingest and the command line on made files."""

import gzip
import json
import os

import pyarrow as pa
import pyarrow.feather as feather
import pytest
import zstandard
from pyspark.sql import functions as F

from cohortloom.config import Paths, biomarker_codebook
from cohortloom.sources import readers, writers
from cohortloom.streaming.ingest import measurement_stream


def write(path, text, how=None):
    data = text.encode()
    data = gzip.compress(data) if how == "gz" else zstandard.compress(data) if how == "zst" else data
    path.write_bytes(data)
    return str(path)


def test_csv(spark, tmp_path):
    write(tmp_path / "a.csv.zst", "x,y\n1,2\n", "zst")
    write(tmp_path / "b.csv.gz", 'x,y\n3,"a ""q"" b"\n4\n5,6,7\n', "gz")
    assert sorted(map(tuple, readers.tolerant_csv(spark, str(tmp_path), "x", "y").collect())) == [("1", "2"), ("3", 'a "q" b'), ("4", None), ("5", "6")]
    assert readers.csv_shards(spark, str(tmp_path / "a.csv.zst"), "x", "y").count() == 1
    assert readers.typed_csv(spark, write(tmp_path / "p.csv", "a,b\n1,2\n"), "a long, b int", "b").collect()[0][0] == 2


def test_protein_files(spark, tmp_path):
    rows = readers.reactome(spark, write(tmp_path / "r.tsv", "P1\tR1\tu\tname\tIEA\tHomo sapiens\n"))
    assert rows.first()["species"] == "Homo sapiens"
    assert readers.string_aliases(spark, write(tmp_path / "a.tsv.gz", "#id\talias\tsource\ns1\tP1\tX\n", "gz")).collect()[0]["alias"] == "P1"
    assert readers.string_links(spark, write(tmp_path / "l.txt.gz", "protein1 protein2 combined_score\ns1 s2 700\n", "gz")).first()["combined_score"] == 700
    g, tissues = readers.gct(spark, write(tmp_path / "x.gct.gz", "#1.2\n2\t2\nName\tDescription\tLiver\tLung\nE1\tg1\t1.5\t2\nE2\tg2\t0\tx\n", "gz"))
    assert tissues == ["Liver", "Lung"] and [tuple(r) for r in g.select("gene", "tpm").orderBy("line").collect()] == [("g1", [1.5, 2.0]), ("g2", [0.0, None])]


@pytest.mark.parametrize("how", [None, "gz"])
def test_fasta(spark, tmp_path, how):
    text = ">sp|P08908|X first\nMKV\nLL A\n>plain two\nAAA\n>empty\n>sp|P08908|Y\nCCC\n"
    f = readers.fasta(spark, write(tmp_path / f"a.fasta{'.gz' if how else ''}", text, how))
    got = {r["id"]: r["sequence"] for r in f.collect()}
    assert got == {"P08908": "CCC", "plain": "AAA"}
    found, missing = readers.proteome_subset(f, spark.createDataFrame([("P08908-2",), (" Q1 ",)], "uniprot_id string"))
    assert found.count() == 1 and [r["id"] for r in missing.collect()] == ["Q1"]
    writers.fasta(f, str(tmp_path / "out"))
    assert {r["id"]: r["sequence"] for r in readers.fasta(spark, str(tmp_path / "out")).collect()} == got


def test_feather(spark, tmp_path):
    feather.write_feather(pa.table({"concept_id": [1, 2], "v": [[1.0], [2.0]]}), tmp_path / "b.feather")
    feather.write_feather(pa.table({"concept_id": [2], "v": [[9.0]]}), tmp_path / "a.feather")
    (tmp_path / ".hidden.feather").write_bytes(b"x")
    df = readers.feather(spark, str(tmp_path), "concept_id long, v array<double>, file string, position long")
    assert sorted((r["concept_id"], r["file"], r["position"]) for r in df.collect()) == [(1, "b.feather", 0), (2, "a.feather", 0), (2, "b.feather", 1)]
    (tmp_path / "bad.feather").write_bytes(b"nonsense")
    assert readers.feather(spark, str(tmp_path), "concept_id long", skip_bad=True).count() == 3
    with pytest.raises(Exception):
        readers.feather(spark, str(tmp_path), "concept_id long").count()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "drug_id long, name string, x int")
    writers.jsonl(df, str(tmp_path / "j"))
    lines = [json.loads(line) for f in (tmp_path / "j").glob("*.json") for line in open(f)]
    assert {"drug_id": 1, "name": "a", "x": None} in lines
    assert readers.jsonl(spark, str(tmp_path / "j"), "drug_id long, name string, x int").count() == 2
    writers.parquet(df, str(tmp_path / "p"), partition="drug_id")
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["drug_id=1", "drug_id=2"]
    assert sorted(r[0] for r in readers.saved_ids(spark, str(tmp_path / "p")).collect()) == [1, 2] and readers.saved_ids(spark, str(tmp_path / "none")).count() == 0
    writers.replace(spark, df, str(tmp_path / "t"))
    writers.replace(spark, spark.read.parquet(str(tmp_path / "t")).where("drug_id = 1"), str(tmp_path / "t"))
    assert readers.row_count(spark, str(tmp_path / "t")) == 1
    writers.sorted_csv(df, str(tmp_path / "c"), "name")
    writers.cohort(spark, str(tmp_path / "k"), {"drug_id": 1}, index=df)
    assert readers.metadata(spark, str(tmp_path / "k")) == {"drug_id": 1} and readers.parquet(spark, str(tmp_path / "k/index"), "name").columns == ["name"]
    os.remove(tmp_path / "k/metadata.json")
    with pytest.raises(FileNotFoundError):
        readers.metadata(spark, str(tmp_path / "k"))
    with pytest.raises(NotADirectoryError):
        readers.metadata(spark, str(tmp_path / "zzz"))
    with pytest.raises(FileNotFoundError):
        readers.require(spark, str(tmp_path / "absent"))
    look = readers.overview(df, "name", "absent")
    assert look["rows"] == 2 and list(look["value_counts"]) == ["name"]


def test_person_table(spark, tmp_path):
    assert readers.person_table(spark, str(tmp_path)) is None
    write(tmp_path / "PERSON.csv", "person_id,year_of_birth,gender_concept_id\n1,1950,8532\n")
    assert readers.person_table(spark, str(tmp_path)).first()["year_of_birth"] == 1950


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = "person_id,measurement_date,measurement_concept_id,value_as_number\n"
    write(folder / "a.csv", head + "1,2020-01-01,3004249,120\n1,2020-01-01,1,120\n2,bad,3004249,x\n")
    args = (spark, str(folder), biomarker_codebook(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
    measurement_stream(*args).awaitTermination()
    write(folder / "b.csv", head + "3,2020-01-02,3004249,130\n")
    measurement_stream(*args).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("person_id").collect()) == [1, 3]


def test_command_line(spark, tmp_path):
    from cohortloom import cli

    raw = tmp_path / "raw"
    for n in ("observation_period", "drug_exposure", "measurement"):
        (raw / n).mkdir(parents=True)
    write(raw / "observation_period/a.csv", "person_id,observation_period_start_date,observation_period_end_date\n" + "".join(f"{i},2010-01-01,2020-01-01\n" for i in range(1, 6)))
    write(raw / "drug_exposure/a.csv", "person_id,drug_concept_id,drug_exposure_start_date,drug_exposure_end_date,days_supply\n" + "".join(f"{i},{100 + i % 2},2015-01-0{i},,\n" for i in range(1, 6)))
    write(raw / "measurement/a.csv", "person_id,measurement_date,measurement_concept_id,value_as_number\n1,2015-01-01,3004249,120\n1,2015-07-02,3004249,110\n")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(raw / name))
    put("concept", [(1, "alpha", "Ingredient", "RxNorm", "S"), (2, "beta", "Ingredient", "RxNorm", "S")], "concept_id long, concept_name string, concept_class_id string, vocabulary_id string, standard_concept string")
    put("concept_ancestor", [(1, 100), (2, 101)], "ancestor_concept_id long, descendant_concept_id long")
    put("mechanisms", [("alpha sodium", "C1", "P1", "AGONIST", None)], "drug_name string, drug_chembl_id string, uniprot_id string, action_type string, mechanism_of_action string")
    put("affinities", [("C1", "P1", "Ki", 5.0)], "drug_chembl_id string, uniprot_id string, standard_type string, min_affinity_nm double")
    put("protein_vectors", [("P1", [1.0, 0.0])], "uniprot_id string, vp array<float>")
    put("text_embeddings", [(1, [1.0, 0.0])], "concept_id long, dense_embedding array<float>")
    cli.main(["all", str(tmp_path)])
    p = Paths(str(tmp_path))
    man = {r["drug_id"]: (r["n_final"], r["status"]) for r in spark.read.parquet(f"{p.cohorts}/manifest").collect()}
    assert man == {1: (2, "SAVED"), 2: (3, "SAVED")}
    out = spark.read.parquet(f"{p.cohorts}/outcomes").collect()
    assert [(r["person_id"], r["baseline_val"], r["m6_val"], r["delta_6m"]) for r in out] == [(1, 120.0, 110.0, -10.0)]
    cli.main(["cohorts", str(tmp_path)])
    assert spark.read.parquet(f"{p.cohorts}/index").count() == 5
    assert spark.read.parquet(f"{p.cohorts}/audit/windows").select(F.sum("n_outside")).first()[0] == 0


def test_feature_stage(spark, tmp_path):
    from cohortloom import cli

    raw = tmp_path / "raw"
    raw.mkdir()
    spark.createDataFrame([("P1", [1.0, 0.0]), ("P2", [0.0, 2.0])], "uniprot_id string, esm2_embedding array<float>").write.parquet(str(raw / "lm_embeddings"))
    spark.createDataFrame([("P1", "g1 protein")], "concept_code string, concept_name string").write.parquet(str(raw / "protein_vocabulary"))
    write(raw / "reactome.tsv", "P1\tR1\tu\tn\tIEA\tHomo sapiens\nP2\tR1\tu\tn\tIEA\tHomo sapiens\nP2\tR2\tu\tn\tIEA\tHomo sapiens\n")
    write(raw / "string_links.txt.gz", "protein1 protein2 combined_score\ns1 s2 900\ns2 s1 900\ns2 s3 800\ns3 s2 800\n", "gz")
    write(raw / "string_aliases.tsv.gz", "#id\talias\tsource\ns1\tP1\tX\n", "gz")
    write(raw / "gtex.gct.gz", "#1.2\n1\t2\nName\tDescription\tLiver\tLung\nE1\tG1\t1.5\t2\n", "gz")
    cli.main(["features", str(tmp_path)])
    got = {r["uniprot_id"]: r["vp"] for r in spark.read.parquet(str(tmp_path / "protein_vectors")).collect()}
    assert set(got) == {"P1", "P2"} and all(len(v) == 2 + 128 + 128 + 2 and abs(sum(x * x for x in v) - 1) < 1e-5 for v in got.values())


def test_cohort_object(spark, tmp_path):
    import datetime as dt

    from cohortloom.cohort import Cohort

    day = dt.date(2015, 1, 1)
    index = spark.createDataFrame([(1, day, day, day, True), (2, day, None, None, False)], "person_id long, t0 date, t_6m date, t_12m date, has_12m_followup boolean")
    feats = spark.createDataFrame([(1, day, 1.0, 0.0), (2, day, 0.0, 3.0)], "person_id long, t0 date, data_0 double, data_1 double")
    c = Cohort(7, "x", index=index).with_features("representations", feats).with_prototypes()
    assert (c.n_patients, c.n_with_12m, c.ingredient_concept_ids) == (2, 1, (7,)) and Cohort(-4).ingredient_concept_ids == ()
    c.save(str(tmp_path / "c"))
    back = Cohort.load(spark, str(tmp_path / "c"))
    assert back.n_patients == 2 and back.outcomes is None and sorted(r["proto"] for r in back.prototypes.collect()) == [[0.0, 1.0], [1.0, 0.0]]
    assert back.distance(c) == pytest.approx(0.0) and back.prediction_times("t_12m").count() == 1
    with pytest.raises(ValueError):
        Cohort(7).n_patients
    with pytest.raises(ValueError):
        Cohort(7, index=index).with_prototypes()
