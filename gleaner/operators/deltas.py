"""A keyed table of versions that is written by deltas and merged when it is read.

A write puts the rows of a batch, dealt by key bucket, into a folder of its own; nothing else is
read or rewritten. Then a manifest names, for each bucket, the write that is its base and those
that came after it. The manifest is written last and never changed, so a reader sees the last
whole version whatever goes on beside it, and of two writers at once the second builds its manifest
on the first's. ``compact`` merges buckets with many deltas into new bases, ``vacuum`` removes what
no kept version names.

Each bucket's ``content`` names the write that last changed its rows; merging leaves it. So two
versions are compared (``changes``) by reading the buckets whose content differs, and no others.

A batch holds each key once (or is told the order by which one counts); null is a key as any other.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bucket, newest

#: Key buckets of a new table; bytes of a bucket's base beyond which merging doubles their number.
BUCKETS, BUCKET_BYTES = 16, 512 << 20
#: Deltas of a bucket from which on it is merged.
MOST_DELTAS = 8
#: How often a writer builds its manifest anew when others were faster.
TRIES = 20
#: Milliseconds after which the claim of a writer that hasn't published is no longer held.
STALE_MS = 600_000
_OWN = ("capturado", "visto_ultima_vez", "vigente")


def _system(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _system(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that a table has, ascending."""
    return sorted(int(x[:-5]) for x in _names(spark, f"{folder}/versions") if x.endswith(".json") and x[:-5].isdigit())


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """What a version consists of; of the last one by default."""
    if version is None:
        known = versions(spark, folder)
        if not known:
            raise FileNotFoundError(f"no table at {folder}")
        version = known[-1]
    fs, path = _system(spark, folder)
    at = fs.open(path(f"{folder}/versions/{version}.json"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8"))
    finally:
        at.close()


def _publish(spark: SparkSession, folder: str, told: dict) -> bool:
    """Writes a manifest under its version's name; False if there is one already."""
    fs, path = _system(spark, folder)
    at, draft = path(f"{folder}/versions/{told['version']}.json"), path(f"{folder}/versions/.{uuid.uuid4().hex}")
    if fs.exists(at):
        return False
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    claim = path(f"{folder}/versions/.{told['version']}.claim")  # created by one writer only, wherever renames replace
    try:
        fs.create(claim, False).close()
    except Py4JJavaError:  # another writer has it, or had it and died
        fs.delete(draft, False)
        if fs.exists(claim) and not fs.exists(at) and time.time() * 1000 - fs.getFileStatus(claim).getModificationTime() > STALE_MS:
            fs.delete(claim, False)
        return False
    return bool(fs.rename(draft, at))


def create(spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS) -> None:
    """An empty table, version 0; what is there stays."""
    kinds = spark.createDataFrame([], schema).schema.json()
    _publish(spark, folder, {"version": 0, "key": key, "schema": kinds, "buckets": buckets, "state": {}, "writes": {}, "streams": {}})


def _write(rows: DataFrame, folder: str, key: str, buckets: int) -> tuple[str, dict[int, int]]:
    """A write's name, and the buckets it has rows of with their bytes."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    # dealt by bucket and a part of it: a bucket's rows are not one task's
    parts = F.pmod(F.xxhash64(F.lit(7), key), F.lit(8))
    rows.withColumn("bucket", bucket(key, buckets)).repartition("bucket", parts).write.partitionBy("bucket").parquet(f"{folder}/data/{name}")
    fs, path = _system(spark, folder)
    sizes = {int(x[7:]): fs.getContentSummary(path(f"{folder}/data/{name}/{x}")).getLength() for x in _names(spark, f"{folder}/data/{name}") if x.startswith("bucket=")}
    return name, sizes


def _commit(spark: SparkSession, folder: str, change: Callable[[dict], dict | None]) -> int:
    """Publishes what change makes of the last manifest, again if another writer was faster; the version (the last one if change gives None)."""
    for _ in range(TRIES):
        last = manifest(spark, folder)
        told = change(json.loads(json.dumps(last)))
        if told is None:
            return last["version"]
        told["version"] = last["version"] + 1
        if _publish(spark, folder, told):
            return told["version"]
    raise RuntimeError(f"{folder} changes too fast")


def _append(spark: SparkSession, folder: str, rows: DataFrame, kind: str, stream: tuple[str, int] | None) -> int:
    def done(told: dict) -> bool:
        return stream is not None and told["streams"].get(stream[0], -1) >= stream[1]

    last = manifest(spark, folder)
    if done(last):
        return last["version"]
    written = {}

    def change(told: dict) -> dict | None:
        if done(told):
            return None
        if told["buckets"] not in written:  # the number of buckets may have grown meanwhile
            written[told["buckets"]] = _write(rows, folder, told["key"], told["buckets"])
        name, sizes = written[told["buckets"]]
        told["writes"][name] = {"version": told["version"] + 1, "kind": kind}
        for b, size in sizes.items():
            own = told["state"].setdefault(str(b), {"base": None, "deltas": [], "content": None, "bytes": 0})
            own["deltas"].append(name)
            own["content"] = name
            own["bytes"] += size
        if stream is not None:
            told["streams"][stream[0]] = stream[1]
        return told

    return _commit(spark, folder, change)


def put(spark: SparkSession, folder: str, batch: DataFrame, now: Column, order: tuple = (), stream: tuple[str, int] | None = None) -> int:
    """Puts a batch in by key, and gives the version: all columns are overwritten but ``capturado``,
    ``visto_ultima_vez`` is now and ``vigente`` true (P3). Of rows of one key the last by ``order`` counts.

    ``stream`` is a stream's name and the number of its batch: one that is in already isn't put in again."""
    told = manifest(spark, folder)
    batch = newest(batch, told["key"], order) if order else batch
    columns = T.StructType.fromJson(json.loads(told["schema"]))
    own = {"capturado": now, "visto_ultima_vez": now, "vigente": F.lit(True)}
    value = lambda f: own.get(f.name, F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name)
    return _append(spark, folder, batch.select(*map(value, columns)), "put", stream)


def patch(spark: SparkSession, folder: str, rows: DataFrame) -> int:
    """Replaces whole rows by key, all columns as they are given, and gives the version."""
    columns = T.StructType.fromJson(json.loads(manifest(spark, folder)["schema"]))
    return _append(spark, folder, rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in columns)), "patch", None)


def _merged(spark: SparkSession, folder: str, told: dict, buckets: list[int]) -> DataFrame:
    """The rows of some buckets as of a manifest."""
    schema, key = T.StructType.fromJson(json.loads(told["schema"])), told["key"]
    state = {b: told["state"][str(b)] for b in buckets if str(b) in told["state"]}
    at = lambda write, b: f"{folder}/data/{write}/bucket={b}"
    plain = spark.read.schema(schema)
    nothing = spark.createDataFrame([], schema)
    still = [at(s["base"], b) for b, s in state.items() if s["base"] and not s["deltas"]]
    bases = [at(s["base"], b) for b, s in state.items() if s["base"] and s["deltas"]]
    out = plain.parquet(*still) if still else nothing
    touched = {(b, w) for b, s in state.items() for w in s["deltas"]}
    if not touched:
        return out
    writes = {w: told["writes"][w] for _, w in touched}
    known = F.create_map(*(x for w, of in writes.items() for x in (F.lit(w), F.struct(F.lit(of["version"]).alias("n"), F.lit(of["kind"] == "patch").alias("whole")))))
    deltas = plain.parquet(*(at(w, b) for b, w in sorted(touched)))
    deltas = deltas.withColumn("_w", F.element_at(known, F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]+)/bucket=", 1)))
    # of each key the last row; narrow rows find it, and what the table captured first
    first = "capturado" in schema.names
    seen = F.col("capturado") if first else F.lit(None)
    last = deltas.groupBy(F.col(key).alias("_key")).agg(F.max("_w.n").alias("_n"), F.min_by(seen, "_w.n").alias("_first"), F.max_by(seen, F.when(F.col("_w.whole"), F.col("_w.n"))).alias("_told"), F.max("_w.whole").alias("_whole"))
    rows = deltas.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_w.n") == F.col("_n")))
    new = rows.select("_first", F.when(F.col("_whole"), F.col("_told")).alias("_told"), "_whole", F.struct(*schema.names).alias("_new"))
    old = (plain.parquet(*bases) if bases else nothing).select(F.struct(*schema.names).alias("_old"))
    # a mark besides: a struct of nulls is not null, but a row that isn't there is
    both = old.withColumn("_there", F.lit(True)).join(new.withColumn("_came", F.lit(True)), F.col(f"_old.{key}").eqNullSafe(F.col(f"_new.{key}")), "full")
    captured = F.when(F.col("_whole"), F.col("_told")).when(F.col("_there"), F.col("_old.capturado")).otherwise(F.col("_first")) if first else None
    value = lambda c: F.when(F.col("_came"), captured if c == "capturado" else F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
    return out.unionByName(both.select(*map(value, schema.names)))


def read(spark: SparkSession, folder: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The table as of a version, the last one by default; of all buckets or of some."""
    told = manifest(spark, folder, version)
    return _merged(spark, folder, told, [int(b) for b in told["state"] if only is None or int(b) in only])


def compact(spark: SparkSession, folder: str, most: int = MOST_DELTAS, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Merges the buckets that have ``most`` deltas or more; all of them, into twice as many, where buckets have grown too large. Gives the version."""
    told = manifest(spark, folder)
    buckets = told["buckets"]
    while told["state"] and sum(s["bytes"] for s in told["state"].values()) > buckets * bucket_bytes:
        buckets *= 2
    grown = buckets > told["buckets"]
    chosen = [int(b) for b, s in told["state"].items() if grown or len(s["deltas"]) >= most]
    if not chosen:
        return told["version"]
    name, sizes = _write(_merged(spark, folder, told, chosen), folder, told["key"], buckets)
    merged = {b: told["state"][str(b)]["deltas"] for b in chosen}

    def change(now: dict) -> dict | None:
        if grown and now["version"] != told["version"] or now["buckets"] != told["buckets"]:
            return None  # what came meanwhile lies in the old buckets: the next time will do
        if grown:
            now["buckets"] = buckets
            now["state"] = {str(b): {"base": name, "deltas": [], "content": name, "bytes": size} for b, size in sizes.items()}
        for b in [] if grown else chosen:
            own = now["state"][str(b)]
            if own["deltas"][: len(merged[b])] != merged[b] or own["base"] != told["state"][str(b)]["base"]:
                return None  # another one has merged it
            own["base"] = name if b in sizes else None
            own["deltas"] = own["deltas"][len(merged[b]) :]
            own["bytes"] = sizes.get(b, 0)
        used = {w for s in now["state"].values() for w in s["deltas"]}
        now["writes"] = {w: of for w, of in now["writes"].items() if w in used}
        return now

    return _commit(spark, folder, change)


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Removes all but the last ``keep`` versions, and the writes that none of these names and that none newer than them made; how many writes went.

    Not to be run while a writer has written but not yet published."""
    known = versions(spark, folder)
    fs, path = _system(spark, folder)
    kept = [manifest(spark, folder, v) for v in known[-keep:]]
    used = {w for m in kept for s in m["state"].values() for w in [s["base"], *s["deltas"]] if w}
    for v in known[:-keep]:
        fs.delete(path(f"{folder}/versions/{v}.json"), False)
    gone = [x for x in _names(spark, f"{folder}/data") if x not in used]
    for x in gone:
        fs.delete(path(posixpath.join(folder, "data", x)), True)
    return len(gone)


def changed_buckets(spark: SparkSession, folder: str, before: int, after: int) -> list[int] | None:
    """The buckets whose rows may differ between two versions; None if they are dealt anew, so that all may."""
    a, b = manifest(spark, folder, before), manifest(spark, folder, after)
    if a["buckets"] != b["buckets"]:
        return None
    content = lambda m, k: m["state"].get(k, {}).get("content")
    return sorted(int(k) for k in {*a["state"], *b["state"]} if content(a, k) != content(b, k))


def changes(spark: SparkSession, folder: str, before: int, after: int) -> DataFrame:
    """The key's column, ``antes`` and ``despues``: the rows that differ between two versions, null where there is none.

    Buckets that haven't changed are not read; of the others, rows are told apart by a hash."""
    told = manifest(spark, folder, after)
    key, buckets = told["key"], changed_buckets(spark, folder, before, after)
    a, b = read(spark, folder, before, buckets), read(spark, folder, after, buckets)
    packed = lambda df, name: df.select(F.struct(*df.columns).alias(name), F.xxhash64(F.to_json(F.struct(*df.columns))).alias(f"_{name}"))
    both = packed(a, "antes").join(packed(b, "despues"), F.col(f"antes.{key}").eqNullSafe(F.col(f"despues.{key}")), "full")
    differ = both.filter(~F.col("_antes").eqNullSafe(F.col("_despues")))
    there = lambda name: F.when(F.col(f"_{name}").isNotNull(), F.col(name)).alias(name)
    return differ.select(F.when(F.col("_despues").isNotNull(), F.col(f"despues.{key}")).otherwise(F.col(f"antes.{key}")).alias(key), there("antes"), there("despues"))
