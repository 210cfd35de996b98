"""The stored index and the catalog over changes, restarts and leftovers."""

import os

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import index as I
from lodestrand.sources import catalog

TEXTS = {1: "alpha beta gamma", 2: "alpha alpha delta", 3: None, 4: "", 5: "omega psi chi beta", 6: "the of and"}
SCHEMA = "doc_id long, text string, key string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in texts.items()], SCHEMA)


def found(index, spark):
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "delta unknown"), (3, "nothing here")], "query_id long, text string")
    return sorted((r.query_id, r.key, r.score, r["rank"]) for r in I.search(index, asked, 3).collect())


def test_refresh_equals_a_rebuild(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "index")
    assert I.load(spark, at) is None
    first = I.refresh(frame(spark, TEXTS), at, "doc_id", "text")
    assert (first.version, first.n_docs, first.segments) == (0, 6, 1) and found(first, spark)[0][:2] == (1, "1")
    assert I.refresh(frame(spark, TEXTS), at, "doc_id", "text").version == 0  # unchanged: nothing written
    changed = {k: t for k, t in TEXTS.items() if k != 2} | {5: "omega delta", 9: "alpha delta beta"}
    second = I.refresh(frame(spark, changed), at, "doc_id", "text")
    assert (second.version, second.segments, second.n_docs) == (1, 2, 6)
    new = spark.read.parquet(f"{at}/segments/segment=1").select("key").distinct().collect()
    assert {r.key for r in new} == {"5", "9"}  # only what changed was tokenized
    rebuilt = I.refresh(frame(spark, changed), str(tmp_path / "other"), "doc_id", "text")
    assert found(second, spark) == found(rebuilt, spark) == found(I.load(spark, at), spark)
    I.load(spark, at).check(frame(spark, changed), "doc_id", "text")
    with pytest.raises(I.StaleIndex):
        I.load(spark, at).check(frame(spark, TEXTS), "doc_id", "text")

    # what an interrupted refresh leaves behind belongs to no version
    spark.createDataFrame([("zeta", "77", 1)], "term string, key string, n long").withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{at}/segments/segment=2")
    assert found(I.load(spark, at), spark) == found(rebuilt, spark)
    third = I.refresh(frame(spark, changed | {77: "zeta zeta"}), at, "doc_id", "text")
    assert third.postings().where("key = '77'").collect()[0].n == 2

    monkeypatch.setattr(I, "MOST_SEGMENTS", 3)
    back = I.refresh(frame(spark, changed), at, "doc_id", "text")  # one segment again
    assert (back.segments, back.first_segment) == (1, 3) and found(back, spark) == found(rebuilt, spark)


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    made = I.refresh(frame(spark, TEXTS), str(tmp_path / "index"), "doc_id", "text")
    bucket = spark.range(1).select(I.bucket_of(F.lit("alpha")).alias("b")).first().b
    plan = made.postings([bucket])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r.term for r in made.postings([bucket]).collect()} >= {"alpha"}


def test_empty_index(spark, tmp_path):
    made = I.refresh(frame(spark, TEXTS).limit(0), str(tmp_path / "index"), "doc_id", "text")
    assert made.n_docs == 0 and found(made, spark) == []


def test_catalog_reads_through(spark, tmp_path):
    root, at = tmp_path / "My Shop!", str(tmp_path / "catalog")
    (root / "app").mkdir(parents=True)
    (root / "app" / "main.py").write_text("x = 1\n")
    assert catalog.entries(spark, at).count() == 0
    assert catalog.scan(spark, str(root), at).count() == 1
    stored = sorted(os.listdir(f"{at}/files/my-shop"))
    again = catalog.scan(spark, str(root), at)
    assert [r.content for r in again.collect()] == ["x = 1\n"] and sorted(os.listdir(f"{at}/files/my-shop")) == stored  # written once
    (root / "app" / "more.py").write_text("y = 2\nz = 3")
    assert catalog.scan(spark, str(root), at).count() == 2 and len(os.listdir(f"{at}/files/my-shop")) == 2
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.py").write_text("a")
    catalog.scan(spark, str(other), at)
    rows = {r.repo_id: (r.name, r.n_files, r.n_lines) for r in catalog.entries(spark, at).collect()}
    assert rows == {"my-shop": ("My Shop!", 2, 4), "other": ("other", 1, 1)}


def test_one_segment_reads_its_postings_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SENT", 2)  # most terms meet their weights by a join
    made = I.refresh(frame(spark, TEXTS), str(tmp_path / "index"), "doc_id", "text")
    assert "keys" not in made.postings()._jdf.queryExecution().executedPlan().toString()  # no join with the keys
    monkeypatch.undo()
    other = I.refresh(frame(spark, TEXTS), str(tmp_path / "other"), "doc_id", "text")
    assert {r.key: r.norm for r in made.norms.collect()} == pytest.approx({r.key: r.norm for r in other.norms.collect()})
