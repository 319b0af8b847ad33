"""Staging: tasks copy a planned list of files and leave digests of their ranges.

Files are copied in waves of a bounded size, a job for each; the log under
``out/.staged`` names a wave's files once all of them are there. A run that
ends early has lost its last wave at most, and the next one copies what the log
doesn't name. Memory is one piece of a file for each task, whatever its size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import remote
from millrace.sources.commits import CommitLog
from millrace.sources.corpus import file_states, staging_plan
from millrace.sources.shared import copy

#: Bytes that a task holds and tells the digest of.
PIECE = 64 << 20
#: Bytes of a wave: what an interrupted run copies again at most.
WAVE = 1 << 40
#: Tasks of a wave at most, and files that the driver copies at a time where
#: tasks can't open a store.
TASKS, COPIES = 4096, 16
FILES = "origin string, source string, target string, length long, time timestamp"
RANGES = f"{FILES}, start long, n long, md5 string"


def copy_file(source: str, target: str, piece: int = PIECE) -> list[tuple[int, int, str]]:
    """Copies one file and returns start, length and MD5 of its pieces; an
    empty file has one. A repeated attempt puts the same file in its place."""
    a, path = remote.opened(source)
    b, temporary, final = remote.place(target, uuid.uuid4().hex)
    told, at = [], 0
    with a.open_input_stream(path) as reader, b.open_output_stream(temporary) as writer:
        while True:
            data = reader.read(piece)
            if not data and told:
                break
            writer.write(data)
            told.append((at, len(data), hashlib.md5(data).hexdigest()))
            at += len(data)
            if not data:
                break
    remote.publish(b, temporary, final)
    return told


def _copied(piece: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                told = pd.DataFrame(copy_file(row.source, row.target, piece), columns=["start", "n", "md5"])
                if int(told["n"].sum()) != row.length:
                    raise OSError(f"{row.source} has {int(told['n'].sum())} bytes, not the {row.length} that were listed")
                yield pd.DataFrame([row._asdict()] * len(told)).assign(**{c: told[c] for c in told.columns})

    return run


def _copied_by_driver(spark: SparkSession, files: list) -> DataFrame:
    """For stores that only Hadoop reaches: lengths are known, digests aren't."""
    with ThreadPoolExecutor(COPIES) as pool:
        list(pool.map(lambda r: copy(spark, r["source"], r["target"]), files))
    return spark.createDataFrame([(*r, 0, r["length"], None) for r in files], RANGES)


def _waves(files: list, most: int) -> Iterator[list]:
    wave, size = [], 0
    for r in files:
        if wave and size + r["length"] > most:
            yield wave
            wave, size = [], 0
        wave.append(r)
        size += r["length"]
    if wave:
        yield wave


def listed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``repo, path, source, length, time`` of all files under each folder; the
    content isn't read, and a folder without files has none."""
    out = spark.createDataFrame([], "repo string, path string, source string, length long, time timestamp")
    for root in sorted({r.rstrip("/") for r in roots}):
        try:
            found = file_states(spark, f"{root}/**")
        except FileNotFoundError:
            continue
        at = F.locate(root.split("://")[-1] + "/", F.col("path")) + len(root.split("://")[-1]) + 1
        out = out.unionByName(found.select(F.lit(root).alias("repo"), F.col("path").substr(at, F.length("path")).alias("path"), F.col("path").alias("source"), "length", "time"))
    return out


def stage(spark: SparkSession, spec: list[dict], out: str, scale: float = 1.0, dry_run: bool = False, wave: int = WAVE, piece: int = PIECE) -> DataFrame:
    """Copies the planned files of each origin to ``out/origin/`` and returns
    the plan. A ``repo`` is any folder that Spark can read; origins without a
    file are left out of the copy. Files that were copied before and have not
    changed since stay as they are."""
    out = out.rstrip("/")
    rows = [(s["origin"], s["repo"].rstrip("/"), s.get("prefix", ""), s.get("capability", s["origin"]), int(s["n_shards"])) for s in spec]
    files = listed(spark, [r[1] for r in rows])
    plan = staging_plan(spark.createDataFrame(rows, "origin string, repo string, prefix string, capability string, n_shards int"), files.select("repo", "path"), scale)
    if dry_run:
        return plan
    chosen = plan.select("origin", "repo", F.explode("chosen").alias("path")).join(files, ["repo", "path"])
    todo = chosen.select("origin", "source", F.concat(F.lit(f"{out}/"), "origin", F.lit("/"), F.substring_index("path", "/", -1)).alias("target"), "length", "time")
    log = CommitLog(spark, f"{out}/.staged")
    if log.last():
        todo = todo.join(staged(spark, out).select("source", "target", "length", "time"), ["source", "target", "length", "time"], "left_anti").select(*todo.columns)
    names = todo.orderBy("target").collect()  # names alone, as the listing had them
    twice = {a["target"] for a, b in zip(names, names[1:]) if a["target"] == b["target"]}
    if twice:
        raise ValueError(f"files of one name in one origin: {sorted(twice)[:5]}")
    for part in _waves(names, wave):
        if all(remote.reachable(p) for r in part for p in (r["source"], r["target"])):
            tasks = min(len(part), TASKS)
            numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(part)], f"{FILES}, number long")
            copied = numbered.repartitionByRange(tasks, "number").drop("number").mapInPandas(_copied(piece), RANGES)
        else:
            copied = _copied_by_driver(spark, part)
        name = log.new("ranges", (log.last() or (0,))[0] + 1)
        copied.write.parquet(log.place(name))
        log.commit({"ranges": [name]})
    return plan


def staged(spark: SparkSession, out: str) -> DataFrame:
    """Ranges of the staged files, of each the copy that was made last."""
    found = None
    for number, path in enumerate(CommitLog(spark, f"{out.rstrip('/')}/.staged").snapshot("ranges")):
        part = spark.read.schema(RANGES).parquet(path).withColumn("_at", F.lit(number))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise FileNotFoundError(f"nothing is staged under {out}")
    last = found.groupBy("target").agg(F.max("_at").alias("_at"))
    return found.join(last, ["target", "_at"]).drop("_at").select("origin", "source", "target", "length", "time", "start", "n", "md5")


def verify(spark: SparkSession, out: str) -> DataFrame:
    """The staged ranges with ``whole``: whether the bytes are what was copied.
    Tasks read single ranges, so one large file is shared out; a file that is
    gone or short has no whole range beyond its end. Null where no digest is known."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(whole=[None if r.md5 is None else _digest(r.target, r.start, r.n) == r.md5 for r in part.itertuples(index=False)])

    ranges = staged(spark, out)
    return ranges.repartition(spark.sparkContext.defaultParallelism, "target", "start").mapInPandas(run, f"{RANGES}, whole boolean")


def _digest(path: str, start: int, n: int) -> str | None:
    store, path = remote.opened(path)
    try:
        with store.open_input_file(path) as f:
            if start + n > f.size():
                return None
            return hashlib.md5(f.read_at(n, start) if n else b"").hexdigest()
    except FileNotFoundError:
        return None
