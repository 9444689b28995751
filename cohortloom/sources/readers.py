"""Readers of the study's inputs. All schemas are explicit; nothing is inferred from the data."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohortloom.sources import files

TEXT = ", ".join


def strings(*names: str) -> str:
    return TEXT(f"`{n}` string" for n in names)


def csv_shards(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Sharded CSV with header, plain, gzip or zstd by file name; all columns as text."""
    return spark.read.schema(strings(*columns)).option("header", True).option("enforceSchema", False).csv(path)


def tolerant_csv(spark: SparkSession, path: str, *columns: str, header: bool = True) -> DataFrame:
    """CSV with doubled quotes and rows of any length: short ones are padded with null, long ones cut."""
    return spark.read.schema(strings(*columns)).option("header", header).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def typed_csv(spark: SparkSession, path: str, schema: str, *keep: str) -> DataFrame:
    """CSV with header and a given schema, some columns of it."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*keep) if keep else df


def tsv(spark: SparkSession, path: str, *columns: str, header: bool = False, sep: str = "\t") -> DataFrame:
    return spark.read.schema(strings(*columns)).option("sep", sep).option("header", header).csv(path)


def reactome(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "uniprot_id", "pathway_id", "url", "pathway_name", "evidence", "species")


def string_aliases(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "string_id", "alias", "source", header=True)


def string_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("protein1 string, protein2 string, combined_score int").option("sep", " ").option("header", True).csv(path)


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def row_count(spark: SparkSession, path: str) -> int:
    """Rows by the files' footers; no column is read."""
    return spark.read.parquet(path).count()


def gct(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(gene, line, tpm array) and the tissue names of a GCT file: two lines before the header."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    head = lines.where(F.col("value").startswith("Name\tDescription")).select("value").first()
    if head is None:
        raise ValueError(f"no GCT header in {path}")
    tissues = head["value"].split("\t")[2:]
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & ~F.col("value").rlike(r"^\d+\t\d+\s*$") & ~F.col("value").startswith("Name\tDescription"))
    tpm = F.transform(F.slice(parts, 3, len(tissues)), lambda x: x.try_cast("double"))
    return rows.select(F.get(parts, F.lit(1)).alias("gene"), "line", tpm.alias("tpm")).where("gene is not null"), tissues


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, sequence), plain or gzip: the id between bars, else the first word; of equal ids the last record; records without sequence are left out."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"), F.monotonically_increasing_id().alias("n"))
    head = F.split_part("v", F.lit("\n"), F.lit(1))
    bar = F.regexp_extract(head, r"\|([A-Z0-9]+)\|", 1)
    seq = F.regexp_replace(F.expr("substr(v, length(split_part(v, '\n', 1)) + 2)"), r"\s", "")
    out = rec.select(F.when(bar != "", bar).otherwise(F.element_at(F.split(head, r"\s+"), 1)).alias("id"), head.alias("header"), seq.alias("sequence"), "n").where("sequence != ''")
    return out.groupBy("id").agg(F.max(F.struct("n", "header", "sequence")).alias("x")).select("id", "x.header", "x.sequence")


def proteome_subset(records: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found records, missing ids) for accessions without isoform suffix; ``wanted`` has uniprot_id."""
    ids = wanted.select(F.split_part(F.trim("uniprot_id"), F.lit("-"), F.lit(1)).alias("id")).where("id != ''").distinct()
    return records.join(ids, "id", "left_semi"), ids.join(records.select("id"), "id", "left_anti")


class FeatherSource(DataSource):
    """``spark.read.format("feather").schema(...).load(folder)``: one task per Feather file, only the asked columns.

    Adds nothing to the files but, if the schema asks for them, ``file`` (its name) and ``position`` (row in the
    file). Option ``skip_bad`` leaves out files that can't be read.
    """

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> str:
        raise ValueError("give the schema of the Feather files")

    def reader(self, schema) -> DataSourceReader:
        return _FeatherReader(schema, dict(self.options))


class _FeatherReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".feather") and not f.startswith(".")) if os.path.isdir(path) else [path]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import feather

        file = partition.value
        names = [f.name for f in self.schema.fields]
        try:
            table = feather.read_table(file, columns=[n for n in names if n not in ("file", "position")])
        except (pa.ArrowInvalid, OSError):
            if self.options.get("skip_bad", "false").lower() == "true":
                return
            raise
        if "file" in names:
            table = table.append_column("file", pa.array([os.path.basename(file)] * table.num_rows, pa.string()))
        if "position" in names:
            table = table.append_column("position", pa.array(range(table.num_rows), pa.int64()))
        yield from table.select(names).to_batches(max_chunksize=4096)


def feather(spark: SparkSession, path: str, schema: str, *, skip_bad: bool = False) -> DataFrame:
    spark.dataSource.register(FeatherSource)
    return spark.read.format("feather").schema(schema).option("skip_bad", str(skip_bad)).load(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def metadata(spark: SparkSession, path: str) -> dict:
    """metadata.json of a saved cohort folder."""
    if not files.is_folder(spark, path):
        raise NotADirectoryError(path)
    file = files.join(path, "metadata.json")
    if not files.exists(spark, file):
        raise FileNotFoundError(file)
    return json.loads(files.read_text(spark, file))


def first_existing(spark: SparkSession, folder: str, *names: str) -> str | None:
    """Path of the first name that exists, on any file system Spark knows."""
    return next((p for p in (files.join(folder, n) for n in names) if files.exists(spark, p)), None)


def person_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """person table by its usual names; None where there is none."""
    path = first_existing(spark, folder, "person.parquet", "person.csv", "PERSON.parquet", "PERSON.csv")
    if path is None:
        return None
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return typed_csv(spark, path, "person_id long, year_of_birth int, gender_concept_id long")


def require(spark: SparkSession, *paths: str) -> None:
    """Fail before anything runs if an input is missing."""
    for p in paths:
        folder, name = os.path.split(p.rstrip("/"))
        if first_existing(spark, folder, name) is None:
            raise FileNotFoundError(f"{p} is missing; build the cache first")


def saved_ids(spark: SparkSession, path: str) -> DataFrame:
    """drug_id of the cohorts already written under ``path``; folders without a number are ignored."""
    if first_existing(spark, *os.path.split(path.rstrip("/"))) is None:
        return spark.createDataFrame([], "drug_id long")
    name: Column = F.regexp_extract(F.input_file_name(), r"drug_id=(-?\d+)/", 1)
    return spark.read.option("basePath", path).parquet(path).select(F.col("drug_id").cast("long").alias("drug_id") if "drug_id" in spark.read.parquet(path).columns else name.cast("long").alias("drug_id")).where("drug_id is not null").distinct()


def overview(df: DataFrame, *counted: str, top: int = 10) -> dict:
    """Rows, columns, first rows and most frequent values: for looking at a table."""
    counts = {c: df.groupBy(c).count().orderBy(F.desc("count"), c).limit(top) for c in counted if c in df.columns}
    return {"rows": df.count(), "columns": df.columns, "head": df.limit(3), "value_counts": counts}
