from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rateforge.catalog import all_queries, model_queries
from rateforge.sources import runlog, tables, tskv


def test_tskv_keeps_awkward_values(spark, tmp_path):
    text = (
        "tskv\taddress=A\tname_ru=N\trubrics=x;y\trating=5.000000\ttext=a=b\r\n"
        "\n"
        "tskv\taddress=A2\tname_ru=tab\there\trubrics=r\trating=bad\ttext=one\rtwo\n"
        "tskv\taddress=first\taddress=last\tname_ru=N3\ttext=\tнет\n"
    )
    path = tmp_path / "raw.tskv"
    path.write_bytes(text.encode())
    df = tskv.read_tskv(spark, str(path))
    rows = df.orderBy("row_id").collect()
    assert df.columns == ["row_id", *tskv.FIELDS]
    assert [r.row_id for r in rows] == [0, 1, 2]
    assert rows[0].text == "a=b"
    assert rows[1].name_ru == "tab\there" and rows[1].text == "one\rtwo"
    assert rows[2].address == "last" and rows[2].rating is None and rows[2].text == "\tнет"
    assert tskv.missing_fields(df).first().asDict() == {"records": 3, "incomplete": 1}
    assert tskv.bad_number_count(df).first()[0] == 1
    assert [r.rating for r in tskv.coerce_rating(df).orderBy("row_id").collect()] == [5.0, None, None]


def test_row_ids_follow_file_order_over_many_blocks(spark, tmp_path):
    path = tmp_path / "big.tskv"
    path.write_text("".join(f"tskv\ttext={i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = tskv.read_tskv(spark, str(path))
        assert df.where(F.col("row_id") != F.col("text").cast("long")).count() == 0
        assert df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_derived_table_is_rebuilt_only_for_new_sources(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.txt").write_text("one\n")
    calls = []

    def build(path):
        calls.append(path)
        return spark.read.text(path)

    for _ in range(2):
        assert tables.derived_table(spark, str(source), str(tmp_path / "c"), build).count() == 1
    (source / "b.txt").write_text("two\n")
    assert tables.derived_table(spark, str(source), str(tmp_path / "c"), build).count() == 2
    assert len(calls) == 2


def test_unfinished_cache_is_built_anew(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.txt").write_text("one\n")
    path = lambda: next((tmp_path / "c").iterdir())
    tables.derived_table(spark, str(source), str(tmp_path / "c"), spark.read.text)
    for f in list(path().iterdir()):
        f.unlink()
    assert tables.derived_table(spark, str(source), str(tmp_path / "c"), spark.read.text).count() == 1


def test_json_result_may_be_missing(spark, tmp_path):
    assert tables.read_json_if_exists(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert tables.read_json_if_exists(spark, str(tmp_path / "x.json")).first()["a"] == 1


def test_predictions_are_pruned_and_missing_ones_fail(spark, tmp_path):
    df = spark.createDataFrame([(1, "m", "val"), (2, "m", "test")], "row_id long, model string, split string")
    tables.write_predictions(df, str(tmp_path / "p"))
    assert [r.row_id for r in tables.read_predictions(spark, str(tmp_path / "p"), "m", "val").collect()] == [1]
    with pytest.raises(FileNotFoundError):
        tables.read_predictions(spark, str(tmp_path / "p"), "other", "val")
    # A second model, and new rows of one split, leave everything else in place.
    tables.write_predictions(spark.createDataFrame([(5, "other", "val")], df.schema), str(tmp_path / "p"))
    tables.write_predictions(spark.createDataFrame([(6, "m", "test")], df.schema), str(tmp_path / "p"))
    stored = {(r.model, r.split, r.row_id) for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    assert stored == {("m", "val", 1), ("m", "test", 6), ("other", "val", 5)}


def test_split_is_published_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "row_id long, g string, split string")
    save = lambda **k: tables.save_split(
        df.drop("split"), df.select("row_id", "split"), str(tmp_path), version="v1", seed=1, group_col="g", **k
    )
    save()
    with pytest.raises(FileExistsError):
        save()
    save(force=True)
    meta = {r["split"]: r for r in tables.split_manifest(spark, str(tmp_path), "v1").collect()}
    assert meta["train"]["rows"] == 1 and meta["test"]["groups"] == 1 and meta["test"]["version"] == "v1"
    assert {(r.row_id, r.split) for r in spark.read.parquet(str(tmp_path / "split_v1")).collect()} == {(1, "train"), (2, "test")}
    assert not list((tmp_path / "_staging").iterdir())


def test_of_two_writers_one_is_refused(spark, tmp_path):
    def writer(seed):
        rows = spark.range(400).selectExpr("id AS row_id", "id % 7 AS g", f"IF(id % {seed} = 0, 'test', 'train') AS split")
        try:
            tables.save_split(rows.drop("split"), rows.select("row_id", "split"), str(tmp_path), version="v2", seed=seed, group_col="g")
            return seed
        except FileExistsError:
            return None

    with ThreadPoolExecutor(3) as pool:
        won = [x for x in pool.map(writer, (2, 3, 5)) if x]
    assert len(won) == 1
    manifest = {r["split"]: r for r in tables.split_manifest(spark, str(tmp_path), "v2").collect()}
    assert {r.seed for r in manifest.values()} == set(won) and manifest["test"]["rows"] == -(-400 // won[0])
    stored = spark.read.parquet(str(tmp_path / "split_v2"))
    assert stored.count() == 400 and stored.where(f"(row_id % {won[0]} = 0) <> (split = 'test')").count() == 0


def test_stored_block_index(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for f in range(3):
        (folder / f"{f}.tskv").write_text("".join(f"tskv\ttext={f * 5000 + i}\n\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        index = tskv.block_index(spark, str(folder), str(tmp_path / "index"))
        assert index.count() > 6 and index.inputFiles() == tskv.block_index(spark, str(folder), str(tmp_path / "index")).inputFiles()
        df = tskv.read_tskv(spark, str(folder), index)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan text") == 1 and "BroadcastHashJoin" in plan
        rows = df.select("row_id", "text").collect()
        assert len(rows) == 15_000 and all(r.row_id == int(r.text) for r in rows)
        # Files that the index does not describe fail, and get an index of their own.
        (folder / "9.tskv").write_text("tskv\ttext=15000\n")
        with pytest.raises(Exception, match="does not describe"):
            tskv.read_tskv(spark, str(folder), index).collect()
        fresh = tskv.read_tskv(spark, str(folder), tskv.block_index(spark, str(folder), str(tmp_path / "index")))
        assert fresh.where("row_id <> cast(text as bigint)").count() == 0 and fresh.count() == 15_001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    first = runlog.log_run(spark, {"model": "a", "model_params": {"b": 1, "a": 2}}, path)
    runlog.log_run(spark, {"model": "b", "experiment_id": "mine"}, path)
    rows = {r.experiment_id: r for r in runlog.read_runs(spark, path).collect()}
    assert set(rows) == {first, "mine"}
    assert rows[first].model_params == '{"a": 2, "b": 1}'
    with pytest.raises(ValueError, match="typo"):
        runlog.log_run(spark, {"typo": 1}, path)


def test_log_of_many_runs_in_one_write(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(5, numPartitions=1).selectExpr("concat('m', id) AS model", "map('z', id, 'a', 1L) AS model_params", "named_struct('y', 2, 'b', array(id)) AS tfidf_params")
    runlog.log_runs(df, path)
    rows = runlog.read_runs(spark, path).orderBy("model").collect()
    assert len(rows) == 5 and rows[3].model_params == '{"a":1,"z":3}' and rows[3].tfidf_params == '{"b":[3],"y":2}'
    assert len({r.experiment_id for r in rows}) == 5 and all(r.phase is None for r in rows)
    assert len(spark.read.parquet(path).inputFiles()) == 1
    with pytest.raises(ValueError, match="typo"):
        runlog.log_runs(df.withColumn("typo", F.lit(1)), path)


def test_raw_files_grow_with_their_text(spark, monkeypatch, tmp_path):
    """The cached scan's raw lines lie in files of bounded size, whose order is that of the ids."""
    folder, sf = tmp_path / "table", "/root/testdata/sf0.001"
    monkeypatch.setattr(model_queries, "_folder", lambda _: str(folder))
    want = sorted(map(tuple, all_queries()["S1_S6_cached_tskv_scan"](spark, sf).collect()), key=str)
    assert len(list((folder / "raw").glob("part-*"))) == 4
    size = sum(f.stat().st_size for f in (folder / "raw").glob("part-*"))
    folder = tmp_path / "more"
    monkeypatch.setattr(model_queries, "RAW_FILE_BYTES", size // 11)
    got = sorted(map(tuple, all_queries()["S1_S6_cached_tskv_scan"](spark, sf).collect()), key=str)
    assert len(list((folder / "raw").glob("part-*"))) >= 10 and got == want
