"""Readers and writers of raw corpora, blocks, caches, traces and maps.

Paths are read through Spark and Hadoop alone, so any store that Spark reads
will do.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.names import clean_origin
from millrace.sources import buckets as by_bucket
from millrace.sources.commits import CommitLog
from millrace.sources.shared import put

BLOCK_SCHEMA = "token_ids array<int>, origin string, origin_tag int, domain string, capability string, n_bytes long, content_hash string, block long, split string"
CACHE_SCHEMA = "content_hash string, origin string, origin_tag int, ref_loss float, n_response_tokens int"
TRACE_SCHEMA = "step long, content_hash string, origin string, origin_tag int, rho double, target_loss double, rank int"
#: What a training row holds; ``ref_loss`` only where it was joined.
ROW_FIELDS = ("token_ids", "origin", "origin_tag", "content_hash", "ref_loss", "capability", "n_bytes")


def glob_root(pattern: str) -> str:
    """The part of a glob before the first component with a wildcard."""
    parts = []
    for part in pattern.split("/"):
        if any(c in part for c in "*?["):
            break
        parts.append(part)
    return "/".join(parts) or "/"


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over paths: ``**`` is any depth, ``*``,
    ``?`` and ``[ab]``, ``[!ab]`` stay within a name. Names that begin with a
    dot are only matched by a dot."""
    out, parts = "", pattern.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += r"(?:(?!\.)[^/]+/)*" + (r"(?!\.)[^/]+" if last else "")
            continue
        body = re.sub(r"\[(!?)(\]?[^\]]*)\]|(\*+)|(\?)|(.)", lambda m: f"[{'^' if m[1] else ''}{_in_class(m[2])}]" if m[2] else "[^/]*" if m[3] else "[^/]" if m[4] else re.escape(m[0]), part)
        out += (r"(?!\.)" if part[:1] in ("*", "?", "[") else "") + body + ("" if last else "/")
    return out


def _in_class(chars: str) -> str:
    return re.sub(r"([\\\[\]^&~|])", r"\\\1", chars)


def list_files(spark: SparkSession, pattern: str, suffix: str = ".parquet") -> list[str]:
    """Sorted files that fit a glob and end with the suffix; of a folder that
    fits, the files right in it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    wild = any(c in pattern for c in "*?[")
    root = jvm.org.apache.hadoop.fs.Path(glob_root(pattern) if wild else pattern)
    fs = root.getFileSystem(conf)
    found, held = [], fs.exists(root)
    in_folder = lambda p: [s.getPath().toString() for s in fs.listStatus(p) if s.isFile()]
    if held and not wild:
        found = in_folder(root)
    elif held:
        below = pattern[len(glob_root(pattern)) :].strip("/")
        base = fs.makeQualified(root).toString().rstrip("/") + "/"
        name = re.compile(glob_regex(below))
        if "**" in below.split("/"):
            walk = fs.listFiles(root, True)
            while walk.hasNext():
                path = walk.next().getPath().toString()
                if name.fullmatch(path[len(base) :]):
                    found.append(path)
        else:
            level = [root]
            for part in below.split("/"):
                # a folder at a time, so that nothing beside the pattern is listed
                fits = re.compile(glob_regex(part))
                level = [s for p in level for s in fs.listStatus(p) if fits.fullmatch(s.getPath().getName())]
                found = [s.getPath().toString() for s in level if s.isFile()]
                level = [s.getPath() for s in level if s.isDirectory()]
            found += [f for p in level for f in in_folder(p)]
    found = sorted(f for f in found if f.endswith(suffix))
    if not found:
        raise FileNotFoundError(f"no {suffix} file fits {pattern!r}")
    return found


def origin_of(path: Column, root: str, coarse: str, per_subset: bool = True, origin_map: dict[str, str] | None = None) -> Column:
    """A file's origin: its first folder under the root, mapped or cleaned;
    files right under the root have the coarse one."""
    if not per_subset:
        return F.lit(coarse)
    below = F.regexp_replace(F.substring_index(path, root.rstrip("/"), -1), "^/+", "")
    subset = F.when(F.instr(below, "/") > 0, F.substring_index(below, "/", 1))
    given = F.create_map(*(F.lit(x) for pair in origin_map.items() for x in pair))[subset] if origin_map else F.lit(None).cast("string")
    return F.when(subset.isNull(), coarse).otherwise(F.coalesce(F.nullif(given, F.lit("")), clean_origin(subset)))


def read_documents(spark: SparkSession, pattern: str, coarse_origin: str, per_subset: bool = True, origin_map: dict[str, str] | None = None, text_column: str = "text", files: list[str] | None = None) -> DataFrame:
    """``origin, part, doc, text`` of all non-empty texts; ``part`` is the
    file, ``doc`` the row in it. ``files`` are those to read of the ones that
    fit the pattern, by default all. The text column is all that is asked of a
    file, so no file's schema is read beforehand: one without it has nulls,
    and so no rows."""
    rows = spark.read.schema(StructType([StructField(text_column, StringType())])).parquet(*(list_files(spark, pattern) if files is None else files))
    rows = rows.select(F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("doc"), F.col(text_column).alias("text")).where("text is not null and text <> ''")
    return rows.select(origin_of(F.col("part"), glob_root(pattern), coarse_origin, per_subset, origin_map).alias("origin"), "part", "doc", "text")



def file_states(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, length, time`` of the files that fit; their content isn't read."""
    found = spark.read.format("binaryFile").load(list_files(spark, pattern))
    return found.select("path", "length", F.col("modificationTime").alias("time"))


def write_blocks(blocks: DataFrame, path: str, shard_rows: int = 50_000, buckets: int | None = None) -> None:
    """Blocks as Parquet by domain and split, so that readers of one prune the
    others; by buckets of their hash too, if a number of them is given, so that
    a cache of as many is joined without a shuffle."""
    if buckets:
        return by_bucket.write(blocks, path, "content_hash", buckets, ("domain", "split"), shard_rows)
    blocks.write.mode("overwrite").option("maxRecordsPerFile", shard_rows).partitionBy("domain", "split").parquet(path)


def read_blocks(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """All blocks, or the first ones; of bucketed ones ``heat`` too."""
    if most is None and by_bucket.told(spark, path):
        return by_bucket.read(spark, path)
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(path).drop(by_bucket.HEAT)
    return rows if most is None else rows.orderBy(F.col("_metadata.file_path"), F.col("_metadata.row_index")).limit(most)


def write_rows(rows: DataFrame, path: str) -> None:
    """Training rows as JSON lines; null values are written, absent columns are not."""
    rows.select(*(c for c in ROW_FIELDS if c in rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token_ids array<int>, origin string, origin_tag int, content_hash string, ref_loss double, capability string, n_bytes long").json(path)


def append_cache(losses: DataFrame, path: str, shard_rows: int = 50_000, buckets: int | None = None) -> None:
    """Behind what the cache holds; by buckets of the hash if a number of them
    is given. A pass holds each hash once, so no bucket grows with one hash."""
    rows = losses.select(F.col("content_hash"), "origin", F.col("origin_tag").cast("int").alias("origin_tag"), F.col("ref_loss").cast("float").alias("ref_loss"), F.col("n_response_tokens").cast("int").alias("n_response_tokens"))
    if buckets:
        return by_bucket.write(rows, path, "content_hash", buckets, shard_rows=shard_rows, append=True, spread=False)
    if by_bucket.told(rows.sparkSession, path):
        raise ValueError(f"{path} is bucketed: later passes need its number of buckets")
    rows.write.mode("append").option("maxRecordsPerFile", shard_rows).parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``content_hash, ref_loss, part, row``; errors if there is nothing to read."""
    if by_bucket.told(spark, path):
        rows = by_bucket.cold(spark, path)
    else:
        list_files(spark, path)
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return rows.select("content_hash", "ref_loss", F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row"))


def append_trace(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).sortWithinPartitions("step", "rank").write.mode("append").json(path)


def read_trace(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``phase, file, line, step, content_hash``: recorded rows in their true
    order; one phase per path; blank lines give no row.

    A path is a folder of JSON lines or the output of a run, of which the
    committed traces count. Files are read line by line and may be split:
    ``line`` is the place of the split in the file and of the line in the split,
    which sorts like the line."""
    out = None
    for phase, path in enumerate(paths):
        log = CommitLog(spark, path)
        where = log.snapshot("trace") if log.last() else [path]
        if not where:
            continue
        text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(where)
        place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
        lines = text.select(F.lit(phase).alias("phase"), F.col("_metadata.file_path").alias("file"), place.alias("line"), F.col("value").alias("_text")).where(F.trim("_text") != "")
        rows = lines.withColumn("_r", F.from_json("_text", TRACE_SCHEMA)).select("phase", "file", "line", "_r.step", "_r.content_hash")
        out = rows if out is None else out.unionByName(rows)
    if out is None or out.limit(1).count() == 0:
        raise FileNotFoundError(f"no trace under {paths}")
    return out


def read_map(spark: SparkSession, path: str | None) -> dict[str, str] | None:
    """A JSON object of strings, from any store."""
    if path is None:
        return None
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return {str(k): str(v) for k, v in found.items()}


def write_map(spark: SparkSession, found: dict[str, str], path: str) -> None:
    put(spark, path, json.dumps(found, indent=2, ensure_ascii=False).encode("utf-8"))


def staging_plan(spec: DataFrame, files: DataFrame, scale: float = 1.0) -> DataFrame:
    """Files to fetch per origin: ``spec`` (origin, repo, prefix, capability,
    n_shards), ``files`` (repo, path); spread evenly over the sorted list."""
    from millrace.functions.arrays import pick_spread

    hits = spec.join(files.withColumnRenamed("repo", "_repo"), (F.col("repo") == F.col("_repo")) & F.col("path").endswith(".parquet") & F.col("path").startswith(F.col("prefix")), "left")
    listed = hits.groupBy("origin", "repo", "prefix", "capability", "n_shards").agg(F.array_sort(F.collect_list("path")).alias("_files"))
    n = F.greatest(F.lit(1), F.bround(F.col("n_shards") * F.lit(float(scale))).cast("int"))
    return listed.select("origin", "repo", "capability", F.size("_files").alias("n_available"), pick_spread(F.col("_files"), n).alias("chosen"))
