"""A catalog of scanned repositories: a row for each, upserted by id, and a scan that reads through it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.sources.tables import scan_repository

ENTRY = "repo_id string, name string, root string, fingerprint string, n_files long, n_lines long, part int"
FILES = "path string, language string, content string, size long, lines int"
#: Folders that the rows of the catalog are dealt into; an upsert writes those of its rows anew.
PARTS = 32


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9-]+", "-"), "^-+|-+$", "")


def entries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(ENTRY).option("basePath", f"{path}/repositories").parquet(f"{path}/repositories").drop("part")
    except AnalysisException:
        return spark.createDataFrame([], ENTRY).drop("part")


def upsert(rows: DataFrame, path: str) -> None:
    """Put rows (repo_id, name, root, fingerprint, n_files, n_lines) into the catalog; a row of the same id gives way.

    Only the folders that hold one of the ids are written, each by a rename of what was written aside.
    """
    spark = rows.sparkSession
    part = F.pmod(F.crc32(F.col("repo_id").cast("binary")), F.lit(PARTS)).cast("int")
    names = [c.split()[0] for c in ENTRY.split(", ")[:-1]]
    new = rows.select(*names).withColumn("part", part)
    touched = new.select("part").distinct()
    old = entries(spark, path).withColumn("part", part).join(touched, "part", "left_semi").join(new.select("repo_id"), "repo_id", "left_anti").select(*names, "part")
    both = old.unionByName(new)
    aside = f"{path}/aside"
    both.write.mode("overwrite").parquet(aside)  # read and overwritten folders must differ
    held = spark.read.schema(ENTRY).parquet(aside)
    held.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/repositories")


def fingerprint(spark: SparkSession, root: str) -> str:
    """A digest of the names, sizes and times of the files below ``root``; their contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    total = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38, 0)")), F.lit(0)).alias("x")).first()
    return f"{total['n']}-{total['x']}"


def scan(spark: SparkSession, root: str, path: str, name: str | None = None) -> DataFrame:
    """Files of the repository at ``root``: those stored at its last scan if nothing changed since then, else scanned and stored."""
    name = name or root.rstrip("/").rsplit("/", 1)[-1]
    repo_id = spark.range(1).select(slug(F.lit(name)).alias("id")).first()["id"]
    now = fingerprint(spark, root)
    known = entries(spark, path).where((F.col("repo_id") == repo_id) & (F.col("root") == root)).first()
    at = f"{path}/files/{repo_id}/{now}"
    if known is None or known["fingerprint"] != now:
        scan_repository(spark, root).write.mode("overwrite").parquet(at)
        sizes = spark.read.schema(FILES).parquet(at).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"))
        upsert(sizes.select(F.lit(repo_id).alias("repo_id"), F.lit(name).alias("name"), F.lit(root).alias("root"), F.lit(now).alias("fingerprint"), "n_files", "n_lines"), path)
    return spark.read.schema(FILES).parquet(at)
