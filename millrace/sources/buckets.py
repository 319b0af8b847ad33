"""Tables bucketed by a key: what joins or groups by the key needs no shuffle.

A table is a folder of Parquet files whose first level tells rows apart:
``heat=cold`` is bucketed by the key; ``heat=hot`` holds the rows of keys that
have more rows than an average bucket, spread evenly, and rows without a key.
As there are fewer such keys than buckets, what they join with can be broadcast,
and no bucket grows with one key. ``_buckets.json`` tells key, number of buckets,
schema and partition columns, so any session can read the folder; plain readers
of Parquet see all rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.shared import _file_system, delete, folders, get, kept, names, put

#: The column that tells whether a row's key is bucketed.
HEAT = "heat"
_TOLD = "_buckets.json"


def told(spark: SparkSession, path: str) -> dict | None:
    """What was written about a bucketed folder; none if it isn't one."""
    path = path.rstrip("/")
    if any(c in path for c in "*?[") or _TOLD not in names(spark, path):
        return None
    return json.loads(get(spark, f"{path}/{_TOLD}"))


def _name(path: str) -> str:
    return "millrace_" + hashlib.md5(path.rstrip("/").encode("utf-8")).hexdigest()


def _register(spark: SparkSession, path: str, spec: dict) -> str:
    """The bucketed part as an external table of this session's catalog; the
    files stay where they are when it is dropped."""
    name, schema = _name(path), StructType.fromJson(spec["schema"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in spec['partitions'])})" if spec["partitions"] else ""
    place = f"{path.rstrip('/')}/{HEAT}=cold".replace("'", "\\'")
    target, fs = _file_system(spark, f"{path.rstrip('/')}/{HEAT}=cold")
    fs.mkdirs(target)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} CLUSTERED BY (`{spec['key']}`) SORTED BY (`{spec['key']}`) INTO {spec['buckets']} BUCKETS LOCATION '{place}'")
    if spec["partitions"]:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    spark.sql(f"REFRESH TABLE {name}")
    return name


def hot_keys(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Keys with more rows than an average bucket: fewer than ``buckets``."""
    total = rows.count()
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * buckets > total).select(key)


def write(rows: DataFrame, path: str, key: str, buckets: int, partitions: Sequence[str] = (), shard_rows: int = 0, append: bool = False, spread: bool = True) -> None:
    """Writes ``rows`` by buckets of ``key``, a file for each bucket and
    partition, or behind what is there with ``append``; the settings must then
    be those of the first time. Without ``spread`` no key is taken for hot: for
    rows that hold a key once."""
    if buckets < 1:
        raise ValueError(f"buckets must be positive, got {buckets}")
    spark, path = rows.sparkSession, path.rstrip("/")
    ordered = [*(c for c in rows.columns if c not in partitions), *partitions]
    rows = kept(rows.select(*ordered), "unbucketed") if spread else rows.select(*ordered)
    spec = {"key": key, "buckets": buckets, "partitions": list(partitions), "schema": json.loads(rows.schema.json())}
    before = told(spark, path) if append else None
    if before and any(before[k] != spec[k] for k in ("key", "buckets", "partitions")):
        raise ValueError(f"{path} is bucketed otherwise: {before['key']}, {before['buckets']}, {before['partitions']}")
    if append and not before and (names(spark, path) or folders(spark, path)):
        raise ValueError(f"{path} holds rows that aren't bucketed")
    if not append:
        delete(spark, path)
    hot = None
    if spread:
        named = F.broadcast(hot_keys(rows, key, buckets))
        hot = rows.join(named, key, "left_semi").unionByName(rows.where(F.col(key).isNull())).select(*ordered)
        rows = rows.where(F.col(key).isNotNull()).join(named, key, "left_anti").select(*ordered)
    if before is None:
        put(spark, f"{path}/{_TOLD}", json.dumps(spec).encode("utf-8"))
    spec = before or spec
    name = _register(spark, path, spec)
    # the shuffle deals rows by the same hash as the buckets, so a task writes one
    out = rows.repartition(buckets, key).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key)
    out = out.option("maxRecordsPerFile", shard_rows)
    (out.partitionBy(*partitions) if partitions else out).saveAsTable(name)
    if hot is not None:
        out = hot.write.mode("append").option("maxRecordsPerFile", shard_rows)
        (out.partitionBy(*partitions) if partitions else out).parquet(f"{path}/{HEAT}=hot")


def cold(spark: SparkSession, path: str) -> DataFrame:
    """The bucketed rows."""
    spec = told(spark, path)
    if spec is None:
        raise FileNotFoundError(f"{path} isn't bucketed")
    return spark.table(_register(spark, path, spec))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their ``heat``; a filter on it leaves one part alone."""
    path, spec = path.rstrip("/"), told(spark, path)
    rows = cold(spark, path).withColumn(HEAT, F.lit("cold"))
    if f"{HEAT}=hot" in folders(spark, path):
        other = spark.read.schema(StructType.fromJson(spec["schema"])).parquet(f"{path}/{HEAT}=hot")
        rows = rows.unionByName(other.select(*(c for c in rows.columns if c != HEAT)).withColumn(HEAT, F.lit("hot")))
    return rows
