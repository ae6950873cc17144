"""The table of deltas: versions, merging, concurrent writers, differences, statistics kept up to date, streams."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators import analytics, deltas, store, views
from gleaner.streaming import ingest

COLUMNS = "k long, v string, w double, capturado timestamp, visto_ultima_vez timestamp, vigente boolean"
DAY = lambda n: datetime.datetime(2026, 1, n)


def at(n):
    return F.lit(f"2026-01-{n:02d} 00:00:00").cast("timestamp")


@pytest.fixture
def folder(spark, tmp_path):
    where = str(tmp_path / "t")
    deltas.create(spark, where, COLUMNS, "k", 4)
    return where


def put(spark, folder, keys, text, day, **more):
    return deltas.put(spark, folder, spark.createDataFrame([(k, text, float(k or 0)) for k in keys], "k long, v string, w double"), at(day), **more)


def rows(spark, folder, version=None, only=None):
    return {r.k: (r.v, r.capturado, r.visto_ultima_vez) for r in deltas.read(spark, folder, version, only).collect()}


def written(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet"))


def test_versions_equal_upserts(spark, folder):
    assert rows(spark, folder) == {} and deltas.versions(spark, folder) == [0]
    put(spark, folder, range(40), "one", 1)
    put(spark, folder, [3, 50, None], "two", 2)
    assert put(spark, folder, [3, None], "three", 3) == 3
    want = {k: ("one", DAY(1), DAY(1)) for k in range(40)} | {50: ("two", DAY(2), DAY(2)), 3: ("three", DAY(1), DAY(3)), None: ("three", DAY(2), DAY(3))}
    assert rows(spark, folder) == want
    assert rows(spark, folder, 1) == {k: ("one", DAY(1), DAY(1)) for k in range(40)}  # older versions stay
    # the same rows by one outer join each
    kinds = "k long, v string, w double, capturado timestamp, visto_ultima_vez timestamp, vigente boolean"
    plain = spark.createDataFrame([], kinds)
    for keys, text, day in ((range(40), "one", 1), ([3, 50], "two", 2), ([3], "three", 3)):
        plain = store.upsert(plain, spark.createDataFrame([(k, text, float(k)) for k in keys], "k long, v string, w double"), "k", at(day))
    assert {r.k: (r.v, r.capturado, r.visto_ultima_vez) for r in plain.collect()} == {k: v for k, v in want.items() if k is not None}
    bucket = {r.k: r.b for r in spark.range(40).select(F.col("id").alias("k"), store.bucket("id", 4).alias("b")).collect()}
    assert set(rows(spark, folder, 1, [2])) == {k for k in range(40) if bucket[k] == 2}


def test_merging_changes_no_row_and_old_files_go(spark, folder):
    for day in range(1, 6):
        put(spark, folder, range(day, 40, day), f"v{day}", day)
    deltas.patch(spark, folder, deltas.read(spark, folder).filter("k < 5").withColumns({"v": F.lit("patched"), "capturado": at(9)}))
    put(spark, folder, [4], "after", 10)
    want = rows(spark, folder)
    assert want[4] == ("after", DAY(9), DAY(10)) and want[3][:2] == ("patched", DAY(9))
    before = deltas.versions(spark, folder)[-1]
    after = deltas.compact(spark, folder, 2)
    assert after == before + 1 and rows(spark, folder) == want and rows(spark, folder, before) == want
    assert deltas.changed_buckets(spark, folder, before, after) == [] and deltas.changes(spark, folder, before, after).isEmpty()
    size = written(folder)
    assert deltas.vacuum(spark, folder) > 0 and written(folder) < size and rows(spark, folder) == want
    assert deltas.versions(spark, folder) == [after]
    put(spark, folder, [100], "new", 11)
    assert rows(spark, folder) == want | {100: ("new", DAY(11), DAY(11))}
    grown = deltas.compact(spark, folder, 99, bucket_bytes=1000)  # buckets grow in number with the table
    assert deltas.manifest(spark, folder)["buckets"] > 4 and rows(spark, folder) == want | {100: ("new", DAY(11), DAY(11))} and deltas.changed_buckets(spark, folder, grown - 1, grown) is None


def test_writes_grow_with_the_batch(spark, folder):
    put(spark, folder, range(20_000), "some text " * 5, 1)
    whole = written(folder)
    put(spark, folder, range(5), "new", 2)
    assert written(folder) - whole < whole / 10


def test_readers_see_whole_versions_only(spark, folder, monkeypatch):
    put(spark, folder, range(10), "one", 1)
    seen = []
    publish = deltas._publish

    def slow(s, where, told):  # all is written but the manifest
        seen.append(rows(spark, folder))
        return publish(s, where, told)

    monkeypatch.setattr(deltas, "_publish", slow)
    put(spark, folder, range(20), "two", 2)
    assert seen == [{k: ("one", DAY(1), DAY(1)) for k in range(10)}] and len(rows(spark, folder)) == 20


def test_of_two_writers_both_get_in(spark, folder, monkeypatch):
    put(spark, folder, range(6), "one", 1)
    publish, first = deltas._publish, []

    def beaten(s, where, told):  # another writer is faster, once
        if not first:
            first.append(True)
            put(spark, folder, [1, 2], "fast", 2)
        return publish(s, where, told)

    monkeypatch.setattr(deltas, "_publish", beaten)
    assert put(spark, folder, [2, 3], "late", 3) == 3
    got = rows(spark, folder)
    assert [got[k][0] for k in range(5)] == ["one", "fast", "late", "late", "one"]


def test_merging_beside_a_writer(spark, folder, monkeypatch):
    for day in (1, 2, 3):
        put(spark, folder, range(10), f"v{day}", day)
    publish, first = deltas._publish, []

    def beaten(s, where, told):
        if not first:
            first.append(True)
            put(spark, folder, [1, 77], "fast", 4)
        return publish(s, where, told)

    monkeypatch.setattr(deltas, "_publish", beaten)
    deltas.compact(spark, folder, 2)
    got = rows(spark, folder)
    assert got[1] == ("fast", DAY(1), DAY(4)) and got[77][0] == "fast" and got[2] == ("v3", DAY(1), DAY(3))


def test_differences_read_changed_buckets(spark, folder):
    a = put(spark, folder, range(400), "one", 1)
    b = deltas.patch(spark, folder, deltas.read(spark, folder).filter("k in (5, 9)").withColumn("v", F.when(F.col("k") == 5, "two").otherwise(F.col("v"))))
    put(spark, folder, [1000], "three", 1)
    got = {r.k: (r.antes.v if r.antes else None, r.despues.v) for r in deltas.changes(spark, folder, a, b + 1).collect()}
    assert got == {5: ("one", "two"), 1000: (None, "three")}
    buckets = deltas.changed_buckets(spark, folder, a, b + 1)
    assert 0 < len(buckets) < 4 or len(buckets) == 3
    read = {f.split("bucket=")[1].split("/")[0] for f in deltas.changes(spark, folder, a, b + 1).inputFiles()}
    assert read == {str(x) for x in buckets}


def test_statistics_follow_the_changes(spark, folder):
    groups = {"par": F.col("k") % 2 == 0, "resto": F.col("k") % 3}
    last = put(spark, folder, range(30), "x", 1)
    view = views.build(deltas.read(spark, folder), groups, F.col("w"))
    for day, keys in ((2, [1, 2, 3, 100, 101]), (3, range(90, 120)), (4, [5])):
        batch = spark.createDataFrame([(k, "y", float(k * day % 17) if k % 4 else None) for k in keys], "k long, v string, w double")
        now = deltas.put(spark, folder, batch, at(day))
        view = views.refresh(view, deltas.changes(spark, folder, last, now), groups, F.col("w"))
        last = now
        table = deltas.read(spark, folder).withColumns(groups)
        assert sorted(map(str, view.collect())) == sorted(map(str, views.build(table, groups, F.col("w")).collect()))
        assert sorted(map(tuple, views.medians(view, "resto").collect())) == sorted(map(tuple, analytics.upper_median(table, "w", "resto").select("resto", "mediana").collect()))
        assert sorted(map(tuple, views.totals(view, "resto").collect())) == sorted(map(tuple, table.groupBy("resto").count().collect()))
    assert {r.resto: (r.total, r.con_sueldo) for r in views.shares(view, ["resto"], "par").collect()} == {r.resto: (r.n, r.p) for r in table.groupBy("resto").agg(F.count(F.lit(1)).alias("n"), F.count_if("par").alias("p")).collect()}


def test_a_stream_puts_each_batch_once(spark, folder, tmp_path):
    source = str(tmp_path / "s")
    for k in range(4):
        spark.createDataFrame([(i, f"b{k}", float(k)) for i in range(k, 10 + k)], "k long, v string, w double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, v string, w double").option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: ingest.upsert_stream(stream, folder, "k", ("v",), "2026-02-01 00:00:00", str(tmp_path / "c"), 2).awaitTermination()
    run()
    want = rows(spark, folder)
    assert len(want) == 13 and want[12][0] == "b3" and want[0][0] == "b0"
    known = deltas.versions(spark, folder)
    run()
    assert deltas.versions(spark, folder) == known
    batch = spark.createDataFrame([(1, "again", 0.0)], "k long, v string, w double")
    assert deltas.put(spark, folder, batch, at(5), stream=(str(tmp_path / "c"), 2)) == known[-1]  # run again after a failure: it is in
    assert rows(spark, folder) == want
