"""Keyed tables that follow a source: only what differs is made anew, and a manifest names the version.

A table lies in a folder as buckets of keys. A manifest, written last and as a whole, says where the
rows of each bucket are. A new version writes the buckets that changed and names the old files of the
others, so its cost goes with the changes. Readers see one version or the next, never half of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from triptych.staging import staged

# Buckets of a new table: about as many as keep the rows of one bucket within a few files.
BUCKETS = 64
MANIFEST = "bucket int, place string, n bigint, producer string, buckets int, batch bigint"
CHANGES = ("new", "changed", "gone")


class Manifest(NamedTuple):
    """Number of a version, what made its rows, how many buckets there are, where each one is, and its last batch."""

    version: int
    producer: str
    buckets: int
    places: dict[int, str]
    batch: int | None = None


def fingerprint(*columns: Column) -> Column:
    """Digest that tells contents apart; missing and empty text differ."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256))


def current(spark: SparkSession, folder: str) -> Manifest | None:
    """The manifest of the newest complete version, None where there is none."""
    found = versions(spark, folder)
    if not found:
        return None
    # One row per bucket, and one that stands for the version as a whole.
    rows = spark.read.schema(MANIFEST).parquet(_manifest(folder, found[-1])).collect()
    head = next(r for r in rows if r.bucket < 0)
    return Manifest(found[-1], head.producer, head.buckets, {r.bucket: r.place for r in rows if r.bucket >= 0}, head.batch)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/*/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def read_version(spark: SparkSession, folder: str, schema: str | StructType, manifest: Manifest | None = None) -> DataFrame:
    """The rows of a version, by default the newest; an empty table where there is none."""
    manifest = manifest or current(spark, folder)
    return _read(spark, folder, schema, sorted(manifest.places.values()) if manifest else [])


def refresh(
    source: DataFrame,
    folder: str,
    make: Callable[[DataFrame], DataFrame],
    schema: str,
    producer: str,
    key: str = "item_id",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Bring the table in `folder` up to its source; returns key and change (new, changed, gone).

    `source` has the key and a column `fingerprint` of all that a row is made from, one row per key;
    rows without key are left out. `make` gets the keys to make and returns rows with the columns of
    `schema`, which begins with the key. The table holds these and the fingerprint. Rows with the
    same fingerprint are kept as they are, unless the saved version is from another `producer` or has
    another number of buckets: then every row is made.

    A version without changes is not written. Two jobs at once cannot both write the next one: the
    later one fails.
    """
    spark = source.sparkSession
    kept_schema = f"{schema}, fingerprint binary"
    old = current(spark, folder)
    usable = old is not None and (old.producer, old.buckets) == (producer, buckets)
    saved = read_version(spark, folder, kept_schema, old) if old else _read(spark, folder, kept_schema, [])
    now = source.where(F.col(key).isNotNull()).select(key, F.col("fingerprint").alias("_now"))
    then = saved.select(key, F.col("fingerprint").alias("_then"))
    change = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "gone")
    change = change.when((F.col("_now") != F.col("_then")) | F.lit(not usable), "changed")
    changes = staged(
        now.join(then, key, "full_outer")
        .select(key, "_now", change.alias("change"))
        .where(F.col("change").isNotNull())
        .withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")),
        "changes",
    )
    touched = {r._bucket for r in changes.select("_bucket").distinct().collect()}
    if not touched and usable:
        return changes.select(key, "change")
    todo = changes.where("change <> 'gone'").select(key, F.col("_now").alias("fingerprint"), "_bucket")
    columns = [f.name for f in StructType.fromDDL(kept_schema)]
    made = make(todo.select(key)).join(todo, key).select(*columns, "_bucket")
    if usable:
        stale = _read(spark, folder, kept_schema, sorted(p for b, p in old.places.items() if b in touched))
        same = stale.join(changes.select(key), key, "left_anti")
        made = made.unionByName(same.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    _write(made, folder, kept_schema, touched, old, usable, producer, buckets)
    return changes.select(key, "change")


def upsert(
    rows: DataFrame, folder: str, schema: str, batch: int, producer: str, key: str = "key", buckets: int = BUCKETS
) -> bool:
    """Replace the rows of these keys, one row per key; whether the batch was not in the table before.

    Batches come in order. One that the table has already, such as the last one after a restart, is
    left out, so each counts once.
    """
    spark = rows.sparkSession
    old = current(spark, folder)
    if old is not None and (old.producer, old.buckets) != (producer, buckets):
        raise ValueError(f"{folder} is a table of {old.producer} with {old.buckets} buckets")
    if old is not None and old.batch is not None and batch <= old.batch:
        return False
    columns = [f.name for f in StructType.fromDDL(schema)]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = staged(rows.select(*columns).withColumn("_bucket", bucket), "upserted")
    touched = {r._bucket for r in fresh.select("_bucket").distinct().collect()}
    stale = _read(spark, folder, schema, sorted(p for b, p in old.places.items() if b in touched) if old else [])
    kept = stale.join(fresh.select(key), key, "left_anti").withColumn("_bucket", bucket)
    _write(fresh.unionByName(kept), folder, schema, touched, old, old is not None, producer, buckets, batch)
    return True


def _write(
    rows: DataFrame,
    folder: str,
    schema: str,
    touched: set[int],
    old: Manifest | None,
    keep: bool,
    producer: str,
    buckets: int,
    batch: int | None = None,
) -> None:
    """Write the touched buckets, then the manifest that names them and, to keep, the old files of the others."""
    spark, place = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    # A bucket goes to one file, or to several where it is large.
    rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{folder}/{place}")
    written = spark.read.schema(f"{schema}, _bucket int").option("basePath", f"{folder}/{place}").parquet(f"{folder}/{place}")
    counts = {r._bucket: r["n"] for r in written.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    places = {b: p for b, p in old.places.items() if b not in touched} if old and keep else {}
    places |= {b: f"{place}/_bucket={b}" for b in counts}
    named = [(b, p, counts.get(b), producer, buckets, batch) for b, p in places.items()]
    manifest = spark.createDataFrame([*named, (-1, None, None, producer, buckets, batch)], MANIFEST).coalesce(1)
    manifest.write.mode("error").parquet(_manifest(folder, old.version + 1 if old else 1))


def forget_old(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete all but the newest `keep` versions and the files that only they name; returns how many went."""
    found = versions(spark, folder)
    kept, gone = found[-keep:], found[:-keep]
    if not gone:
        return 0
    named = lambda numbers: {
        r.place
        for number in numbers
        for r in spark.read.schema(MANIFEST).parquet(_manifest(folder, number)).where("place is not null").collect()
    }
    unused = named(gone) - named(kept)
    for path in [*[_manifest(folder, number) for number in gone], *[f"{folder}/{place}" for place in sorted(unused)]]:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return len(gone)


def _manifest(folder: str, version: int) -> str:
    return f"{folder}/manifest/{version:08}"


def _read(spark: SparkSession, folder: str, schema: str | StructType, places: list[str]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{place}" for place in places])
