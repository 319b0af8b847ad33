"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions by application: a running session does
#: not let the setting be changed.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it.

    Where none is set, a local session (tests) gets a temporary folder, the
    same as long as it lasts; on a cluster that would be another folder on each
    machine, so there it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        found = _LOCAL.get(context.applicationId)
        if found is None:
            found = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows reads
    it as often as it likes, plans stay short, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


#: Steps of a plan that cost little to run twice: a scan and what it does by row.
_PLAIN = ("Project", "Filter", "LogicalRelation", "Relation", "SubqueryAlias")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that may be read more than once: itself if it does no
    more than scan files, which prunes columns at each read, else stored."""
    todo, plain = [df._jdf.queryExecution().optimizedPlan()], True
    while todo and plain:
        node = todo.pop()
        plain = node.nodeName().split(" ")[0] in _PLAIN
        todo += [node.children().apply(i) for i in range(node.children().size())]
    text = df._jdf.queryExecution().optimizedPlan().toString() if plain else ""
    return df if plain and "PythonUDF" not in text and "relation" in text.lower() else store(df, name)


def drop(df: DataFrame) -> None:
    """Remove a table that :func:`store` wrote, once nothing reads it any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let go of what finished plans leave: shuffle files and broadcasts stay on
    all machines until the driver happens to collect its garbage, which one with
    room to spare puts off, while its heap grows. For long loops, once a step."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Remove all tables that were left in the shared folder. Results that
    still read them must be written first."""
    delete(spark, f"{shared_dir(spark)}/millrace")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under ``path``; none where it doesn't exist."""
    target, fs = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()) if fs.exists(target) else []


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right under ``path``; none where it doesn't exist."""
    target, fs = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isFile()) if fs.exists(target) else []


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, to any store."""
    target, fs = _file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(content)
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> bytes:
    """A small file, from any store; hidden names too, which Spark skips."""
    target, fs = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def copy(spark: SparkSession, path: str, to: str) -> None:
    """A file from any store to any other, as it is."""
    source, a = _file_system(spark, path)
    target, b = _file_system(spark, to)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, source, b, target, False, spark._jsc.hadoopConfiguration())
