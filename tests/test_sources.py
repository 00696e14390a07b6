import os

import pytest
from pyspark.sql import functions as F

from yardstats import session
from yardstats.operators.audit import append_audit
from yardstats.plans.sample import Sample
from yardstats.schemas import CATALOGUE_NAMES
from yardstats.sinks.export import read_csv, write_by_month, write_csv
from yardstats.sources.tables import jdbc_options, read_catalogue, read_table


def test_stored_table_is_read_with_its_schema(spark, tmp_path):
    Sample(spark, "/root/testdata/sf0.001").vehicle().write.parquet(str(tmp_path / "vehicle"))
    table = read_table(spark, f"{tmp_path}/", "vehicle")
    assert [f.name for f in table.schema] == ["stocknumber_id", "regnumber", "location_id"]
    assert table.count() == 150


def test_database_scan_is_cut_into_key_ranges():
    options = jdbc_options("jdbc:x", "invoice", "invoice_id", 0, 1000, 8)
    assert options["partitionColumn"] == "invoice_id" and options["numPartitions"] == "8"
    assert (options["lowerBound"], options["upperBound"]) == ("0", "1000")


class FakeSession:
    """A session with the given settings, for what a running one cannot change."""

    def __init__(self, master, **settings):
        self.settings, self.master, self.folder = settings, master, None
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_is_the_one_the_session_names():
    named = FakeSession("spark://cluster", spark_checkpoint_dir="hdfs://x/y/")
    assert session.shared_folder(named) == "hdfs://x/y"
    first, second = session.work_path(named, "a"), session.work_path(named, "a")
    assert first != second and first.startswith("hdfs://x/y/a-")


def test_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError):
        session.shared_folder(FakeSession("spark://cluster"))


def test_local_session_gets_a_folder_and_keeps_it():
    local = FakeSession("local[2]")
    assert session.shared_folder(local) == session.shared_folder(local) == local.folder


def test_write_through(spark):
    kept = session.write_through(spark.range(5), "five")
    assert sorted(r.id for r in kept.collect()) == list(range(5))
    folder = session.shared_folder(spark)
    assert all(f"{folder.removeprefix('file:')}/five-" in f for f in kept.inputFiles())


def test_catalogue_columns_are_found_by_name(spark, tmp_path):
    names = list(CATALOGUE_NAMES)
    values = {"Model": "Golf", "Part": '  a "b", c ', "IC Start Year": "1999.0", "IC End Year": "x", "B Price": "1e2"}
    row = {n: values.get(n, "5") for n in names} | {"More": "zzz"}
    path = str(tmp_path / "catalogue")
    columns = ["More", *reversed(names)]
    write_csv(spark.createDataFrame([tuple(row[c] for c in columns)], ", ".join(f"`{c}` string" for c in columns)), path)
    got = read_catalogue(spark, path).first()
    assert (got.model, got.part, got.ic_start_year, got.ic_end_year, got.b_price) == ("Golf", '  a "b", c ', 1999, None, 100.0)
    short = str(tmp_path / "short")
    write_csv(spark.createDataFrame([("Golf",)], "Model string"), short)
    with pytest.raises(ValueError):
        read_catalogue(spark, short)


def test_an_export_keeps_blanks_quotes_and_commas(spark, tmp_path):
    path = str(tmp_path / "out")
    texts = ["  a  ", 'x "y"', "1,2", "a\\b", "two\nlines", None]
    write_csv(spark.createDataFrame([(t, "k") for t in texts], "t string, k string"), path)
    assert {r.t for r in read_csv(spark, path).collect()} == set(texts)


def test_few_files_per_day_and_month(spark, tmp_path):
    rows = spark.range(4000).select(
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, int(id % 20))").alias("event_time"), F.col("id").alias("log_id")
    ).repartition(16)
    append_audit(rows, f"{tmp_path}/log")
    write_by_month(rows, f"{tmp_path}/months", "event_time")
    for name, most in (("log", 4 * 20), ("months", 8)):
        files = list((tmp_path / name).rglob("*.parquet"))
        assert 0 < len(files) <= most
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 4000


def test_intermediate_results_can_be_deleted(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    stored = session.write_through(spark.range(3), "passing")
    (folder,) = session._made
    assert stored.count() == 3 and session.release(spark) == 1
    assert not os.path.exists(folder.removeprefix("file:")) and session.release(spark) == 0
