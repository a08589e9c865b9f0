from datetime import datetime

from pyspark.sql import functions as F

from corpuscope.operators import history
from corpuscope.operators.rule_packs import SECURITY
from corpuscope.operators.scan import scan_files
from corpuscope.streaming import findings as st


def test_stream_findings_equal_batch(spark, files, tmp_path):
    df = files(*[("r", f"{i}.py", "Python", "\n".join(["a"] * 4 + ["x = eval(y)"])) for i in range(5)])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = st.run_available(st.stream_findings(stream, SECURITY), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(str, got.collect())) == sorted(map(str, scan_files(df, SECURITY).collect()))


def _write(spark, path, rows):
    spark.createDataFrame(rows, "k string, t string, v int").withColumn(
        "t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped_and_windows_closed(spark, tmp_path):
    src = str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema("k string, t timestamp, v int").parquet(src)
        rows = st.stream_trend(stream, "t", "v", ["k"], "1 day", delay="1 day")
        return st.run_available(rows, str(tmp_path / "out"), str(tmp_path / "cp"))

    _write(spark, src, [("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-05 10:00:00", 2)])
    run()
    _write(spark, src, [("a", "2024-01-01 11:00:00", 9), ("a", "2024-01-09 10:00:00", 3)])
    got = {(str(r.window_start)[:10], r.run_count, r.best) for r in run().collect()}
    assert got == {("2024-01-01", 1, 1), ("2024-01-05", 1, 2)}


def test_dedup_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema("k string, t timestamp, v int").parquet(src)
        return st.run_available(
            st.stream_dedup(stream, ["k"], "t", "10 days"), str(tmp_path / "out"), str(tmp_path / "cp"))

    _write(spark, src, [("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 11:00:00", 2)])
    run()
    _write(spark, src, [("a", "2024-01-02 10:00:00", 3), ("b", "2024-01-02 10:00:00", 4)])
    assert sorted(r.k for r in run().collect()) == ["a", "b"]


def test_upsert_keeps_first_seen_over_batches(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")

    def run():
        stream = spark.readStream.schema("k string, t timestamp, v int").parquet(src)
        st.stream_upsert(stream, table, str(tmp_path / "cp"), ["k"], "t", ["v"])
        return {r.k: (r.v, str(r.created_at)[:10], str(r.last_seen)[:10])
                for r in st.read_upserted(spark, table, ["k"], ["v"]).collect()}

    _write(spark, src, [("a", "2024-01-02 00:00:00", 1), ("a", "2024-01-01 00:00:00", 5)])
    assert run() == {"a": (1, "2024-01-01", "2024-01-02")}
    _write(spark, src, [("a", "2024-01-03 00:00:00", 7), ("b", "2024-01-01 00:00:00", 2)])
    assert run() == {"a": (7, "2024-01-01", "2024-01-03"), "b": (2, "2024-01-01", "2024-01-01")}
    st.compact_upserted(spark, table, str(tmp_path / "compact"), ["k"], ["v"])
    assert st.read_upserted(spark, str(tmp_path / "compact"), ["k"], ["v"]).count() == 2


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    src, table = str(tmp_path / "in"), tmp_path / "table"

    def run(checkpoint="cp"):
        stream = spark.readStream.schema("k string, t timestamp, v int").parquet(src)
        st.stream_upsert(stream, str(table), str(tmp_path / checkpoint), ["k"], "t", ["v"])
        return sorted(map(str, st.read_upserted(spark, str(table), ["k"], ["v"]).collect()))

    _write(spark, src, [(f"k{i}", "2024-01-02 00:00:00", i) for i in range(300)])
    run()
    assert len(list((table / "gen=0").glob("bucket=*"))) > 50
    _write(spark, src, [("k7", "2024-01-03 00:00:00", 1), ("k7", "2024-01-01 00:00:00", 2)])
    rows = run()
    assert len(list((table / "gen=1").glob("bucket=*"))) == 1 and len(rows) == 300
    # the batch is run again, as after a failure, and a half-written one lies beside it
    (table / "gen=1" / "_SUCCESS").unlink()
    assert sorted(map(str, st.read_upserted(spark, str(table), ["k"], ["v"]).collect())) != rows
    commit = tmp_path / "cp" / "commits" / "1"
    commit.unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run() == rows


def test_rollup_of_batches_equals_the_whole(spark, tmp_path):
    schema = "user_id int, repo string, repo_name string, analyzed_at timestamp, run_id int, quality_score double, security_high int"
    rows = [(i % 2, f"r{i % 3}", f"name{i}", datetime(2024, 1, 1 + i % 9, i % 24), i, None if i == 4 else float(i * 7 % 50), i % 5)
            for i in range(40)]
    rows.append((9, "late", "x", datetime(2020, 1, 1), 99, 1.0, 3))
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    for batch in (rows[:15], rows[15:40], rows[40:]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        st.stream_rollup(stream, table, str(tmp_path / "cp"))
    # the last batch comes a second time
    st.rollup_parts(spark.createDataFrame(rows[40:], schema)).write.mode("overwrite").parquet(f"{table}/batch=2")
    whole, parts = spark.createDataFrame(rows, schema), st.read_rollup(spark, table)
    assert sorted(map(str, history.finish_rollup(parts).collect())) == sorted(map(str, history.repo_rollup(whole).collect()))
    for limit in (None, 2):
        got, want = history.finish_leaderboard(parts, limit), history.leaderboard(whole, limit)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_alerts_only_for_high(spark):
    df = spark.createDataFrame([("r", "HIGH", "t", "f"), ("r", "LOW", "t", "f")],
                               "repo string, severity string, title string, file_path string")
    rows = st.stream_high_alerts(df).collect()
    assert len(rows) == 1 and '"value":"t"' in rows[0].payload
