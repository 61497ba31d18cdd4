from pathlib import Path

import pytest
from pyspark.sql import functions as F

from usagelens.operators import features
from usagelens.schema import TELECOM, normalise_names, snake_case
from usagelens.sources import files, tables
from usagelens.workspace import drop_scratch, materialise, shared_root


def test_raw_header_is_normalised(spark):
    df = spark.range(1).select(F.lit(1.0).alias(" Dur. (ms) "), F.lit(2).alias("MSISDN/Number"),
                               F.lit(3.0).alias("Youtube DL (Bytes)"), F.lit(4).alias("Extra (x)"))
    assert normalise_names(df, TELECOM).columns == ["dur_ms", "user_id", "youtube_dl", "extra_x"]
    assert snake_case("Avg RTT DL (ms)") == "avg_rtt_dl_ms"


def test_csv_sessions_are_typed_by_role(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("MSISDN/Number,IMSI,Dur. (ms),Handset Type,Avg RTT DL (ms)\n"
                    "33664962239,2.08201E+14,1000.5,phone,NaN\n,,,,\n")
    df = files.read_sessions(spark, str(path), "csv")
    types = dict(df.dtypes)
    assert types["user_id"] == "decimal(20,0)" and types["dur_ms"] == "double"
    row = df.where("user_id IS NOT NULL").first()
    assert int(row.user_id) == 33664962239 and int(row.imsi) == 208201000000000
    assert row.rtt_dl_ms is None and df.count() == 2


def test_rejected_cells_are_named(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(" MSISDN/Number ,Dur. (ms)  ,Handset Type,Start\n"
                    "12,soon,phone,2024-01-01 00:00:00\nx,7.5,,never\n,NaN,,\n1,2\n5,6,a,,more\n")
    df = files.read_sessions(spark, str(path), "csv", rejected="bad")
    assert df.columns == ["user_id", "dur_ms", "handset_type", "start_ts", "bad"]
    rows = {str(r.user_id): (r.dur_ms, r.bad) for r in df.collect()}
    assert rows["12"] == (None, ["dur_ms"])
    assert sorted(r.bad for r in df.where("user_id IS NULL").collect()) == [[], ["user_id", "start_ts"]]
    assert rows["1"] == (2.0, [files.LINE]) and rows["5"] == (6.0, [files.LINE])
    counts = {r.variable: r.rows for r in files.rejection_counts(df, "bad").collect()}
    assert counts == {"dur_ms": 1, "user_id": 1, "start_ts": 1, files.LINE: 2}
    with pytest.raises(ValueError):
        files.read_sessions(spark, str(path), "parquet", rejected="bad")


def test_raw_header_and_back(spark, sessions, tmp_path):
    path = str(tmp_path / "raw")
    files.raw_header(sessions, pad=" ").write.parquet(path)
    assert " Dur. (ms) " in spark.read.parquet(path).columns
    assert files.read_sessions(spark, path).columns == sessions.columns


def test_field_descriptions(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("Fields , Description\nDur,Length\n")
    assert files.read_field_descriptions(spark, str(path)).columns == ["Fields", "Description"]


def test_nan_becomes_null(spark):
    df = files.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, n int"))
    assert df.agg(F.avg("x")).first()[0] == 2.0


def test_feature_store(spark, users, tmp_path):
    path = str(tmp_path / "feature")
    with pytest.raises(FileNotFoundError):
        files.load_feature(spark, path)
    for _ in range(2):
        files.save_feature(users, path)
    assert files.load_feature(spark, path).count() == users.count()


def test_cleaned_table_is_reused_until_forced(spark, sessions, tmp_path):
    path, calls = str(tmp_path / "cleaned"), []

    def source():
        calls.append(1)
        return sessions
    for force in (False, False, True):
        got = files.load_or_create_cleaned(spark, path, source, force_reload=force)
    assert len(calls) == 2 and "total_data" in got.columns and got.count() == sessions.count()


def test_cleaned_table_follows_its_input(spark, sessions, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "cleaned")
    calls = []

    def stored(**settings):
        def read():
            calls.append(1)
            return spark.read.parquet(source)
        return files.load_or_create_cleaned(spark, path, read, inputs=[source], **settings)

    sessions.limit(50).write.parquet(source)
    old = stored()
    assert old.count() == 50 and stored().count() == 50 and len(calls) == 1
    sessions.write.mode("overwrite").parquet(source)
    assert stored().count() == sessions.count() and len(calls) == 2
    assert files.Manifest.read(spark, path).rows == sessions.count()
    assert old.count() == 50  # the version before stays for its readers
    stored(id_policy="mean")
    assert len(calls) == 3 and stored(id_policy="mean").where("user_id IS NULL").count() == 0
    kept = [p.name for p in Path(path).iterdir() if p.name.startswith("version-")]
    assert len(kept) == 2
    with pytest.raises(FileNotFoundError):
        files.input_fingerprint(spark, [str(tmp_path / "nowhere")])


def test_a_stored_model_cleans_like_stored_rows(spark, sessions, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "model")
    some = sessions.withColumn("empty", F.lit(None).cast("double")).withColumn("blank", F.lit(None).cast("string"))

    def stored(**settings):
        return files.load_or_create_cleaned(spark, path, lambda: spark.read.parquet(source),
                                            inputs=[source], keep="model", **settings)

    def rows(df):
        return sorted([tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.collect()])

    for part in (some.limit(50), some):
        part.write.mode("overwrite").parquet(source)
        for settings in ({}, {}, {"id_policy": "mean"}):
            assert rows(stored(**settings)) == rows(files.clean(spark.read.parquet(source), **settings))
    assert len(files.StoredTable(spark, path).fingerprints()) == 4
    with pytest.raises(ValueError):
        files.load_or_create_cleaned(spark, path, lambda: some, keep="nothing")


def test_a_failed_build_leaves_the_table(spark, tmp_path):
    table = files.StoredTable(spark, str(tmp_path / "t"))
    assert table.current() is None
    table.replace(spark.range(3), "a")
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        table.replace(broken, "b")
    assert table.current("b") is None and table.current("a").count() == 3
    assert table.load_or_create("b", lambda: spark.range(4)).count() == 4
    assert table.current().count() == 4


def test_table_sink_modes(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "customer_id")
    assert tables.export_table(df, "scores_test", path=str(tmp_path / "t")) is True
    tables.export_table(df, "scores_test", "append")
    assert tables.read_table(spark, "scores_test").count() == 6
    with pytest.raises(Exception, match="already exists"):
        tables.export_table(df, "scores_test", "fail")
    with pytest.raises(ValueError):
        tables.export_table(df, "scores_test", "maybe")
    assert tables.run_query(spark, "SELECT max(customer_id) AS m FROM scores_test").first().m == 2
    assert tables.run_query(spark, "SELECT count(*) AS n FROM {t}", t=df).first().n == 3
    spark.sql("DROP TABLE scores_test")


def test_scratch_tables(spark, tmp_path):
    kept = materialise(spark.range(5).withColumn("x", F.col("id") * 2))
    assert kept.count() == 5 and kept.columns == ["id", "x"]
    assert spark.sparkContext.applicationId in shared_root(spark)


def test_scratch_is_dropped_as_a_whole(spark):
    materialise(spark.range(3))
    root = Path(shared_root(spark).removeprefix("file:"))
    assert list(root.iterdir())
    drop_scratch(spark)
    assert not root.exists()


def test_scratch_needs_a_named_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(RuntimeError):
        shared_root(spark)


def test_absent_user_column_fails_early(spark):
    with pytest.raises(KeyError):
        features.user_engagement(spark.range(1))
