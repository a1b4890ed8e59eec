"""Published marts, tables that grow by columns."""

import pytest
from pyspark.sql import functions as F

from plantlens.plans.marts import Plant, publish_marts, stored_marts
from plantlens.sources import tables


def test_versions_digest_and_reader(spark, tmp_path):
    root = str(tmp_path / "marts")
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("t"))
    one = tables.publish_mart(df, root, "m", "stage", ["t", "k", "id"], ["k"])
    two = tables.publish_mart(df.repartition(5), root, "m", "stage", ["t", "k", "id"], ["k"])
    assert (one["version"], two["version"]) == (1, 2) and one["hash_sum"] == two["hash_sum"] and one["n_rows"] == 100
    three = tables.publish_mart(df.limit(99), root, "m", "stage", ["t", "k", "id"])
    assert three["hash_sum"] != one["hash_sum"]
    assert tables.open_mart(spark, root, "m").count() == 99
    old = tables.open_mart(spark, root, "m", 1)
    assert old.columns == ["t", "k", "id"] and old.count() == 100
    with pytest.raises(ValueError):
        tables.publish_mart(df, root, "m", "another stage")
    assert tables.expire_mart(spark, root, "m", keep=1) == 2
    assert tables.open_mart(spark, root, "m").count() == 99 and len(tables.manifests(spark, root, "m")) == 1


def test_an_interrupted_write_leaves_the_last_version(spark, tmp_path):
    root = str(tmp_path / "marts")
    tables.publish_mart(spark.range(3), root, "m", "s")
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.publish_mart(broken, root, "m", "s")
    assert tables.open_mart(spark, root, "m").count() == 3
    assert tables.publish_mart(spark.range(4), root, "m", "s")["version"] == 2
    with pytest.raises(FileNotFoundError):
        tables.open_mart(spark, root, "none")


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "a.json")
    tables.write_small(spark, path, "{}")
    with pytest.raises(FileExistsError):
        tables.write_small(spark, path, "{}")
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".json"] == ["a.json"]


def test_findings_from_stored_marts(spark, sf_dir, tmp_path):
    """A rerun gives the same digests, and findings need no source once marts are stored."""
    root = str(tmp_path / "marts")
    first = publish_marts(Plant(spark, sf_dir), root)
    again = publish_marts(Plant(spark, sf_dir), root)
    assert {k: (v["n_rows"], v["hash_sum"]) for k, v in first.items()} == {k: (v["n_rows"], v["hash_sum"]) for k, v in again.items()}
    later = Plant(spark, "/no/such/folder", stored=stored_marts(spark, root))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(later.findings) == rows(Plant(spark, sf_dir).findings)
    assert rows(later.extent) == rows(Plant(spark, sf_dir).extent)
    assert later.scorecard_mart.count() == 9


def test_a_table_grows_by_columns_in_place(spark):
    name = "evolve_test.mart"
    spark.sql("DROP TABLE IF EXISTS evolve_test.mart")
    tables.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "n long, p string"), "evolve_test", "mart", ["p"])
    reader = spark.table(name).select("n", "p")
    files = lambda p: sorted(f for f in spark.table(name).filter(F.col("p") == p).inputFiles())
    untouched = files("a")
    tables.write_table(spark.createDataFrame([("b", 9, 2.5)], "p string, n long, more double"), "evolve_test", "mart", ["p"])
    assert sorted((r.n, r.p, r.more) for r in spark.table(name).collect()) == [(1, "a", None), (9, "b", 2.5)]
    assert files("a") == untouched
    assert sorted(map(tuple, reader.collect())) in ([(1, "a"), (2, "b")], [(1, "a"), (9, "b")])
    assert sorted((r.n, r.p) for r in spark.table(name).select("n", "p").collect()) == [(1, "a"), (9, "b")]
    tables.write_table(spark.createDataFrame([(5, "c")], "n long, p string"), "evolve_test", "mart", ["p"])
    assert spark.table(name).filter("p = 'c'").collect()[0].more is None
    with pytest.raises(ValueError):
        tables.write_table(spark.createDataFrame([("x", "c")], "n string, p string"), "evolve_test", "mart", ["p"])
