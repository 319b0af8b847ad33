"""Weight tensors: safetensors files to and from tables."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from millrace.sources import remote
from millrace.sources.corpus import list_files
from millrace.sources.shared import copy, get

INDEX = "model.safetensors.index.json"
#: Bytes of tensors that a task reads, if they are more than one, and tasks
#: that write.
PART_BYTES, MOST_TASKS = 1 << 27, 4096
#: Values that a written shard holds at most, as single-precision bytes.
SHARD_BYTES = 1 << 28
SCHEMA = "name string, shape array<int>, dtype string, values array<float>"
#: Names of types in the format, the table's names, numpy's types.
TYPES = {"F32": ("float32", "<f4"), "F16": ("float16", "<f2"), "F64": ("float64", "<f8"), "BF16": ("bfloat16", "<u2"), "I8": ("int8", "<i1"), "I32": ("int32", "<i4"), "I64": ("int64", "<i8"), "U8": ("uint8", "<u1")}


def shards(spark: SparkSession, folder: str) -> list[str]:
    """The shards that an index names, else all in the folder, sorted; one
    that is named but absent is an error."""
    folder = folder.rstrip("/")
    found = list_files(spark, f"{folder}/*", ".safetensors")
    try:
        index = list_files(spark, f"{folder}/*", ".index.json")
    except FileNotFoundError:
        return found
    named = json.loads(spark.read.text(index[0], wholetext=True).first()[0])["weight_map"]
    by_name = {f.rsplit("/", 1)[1]: f for f in found}
    lost = sorted(set(named.values()) - set(by_name))
    if lost:
        raise FileNotFoundError(f"shards missing: {lost}")
    return sorted(by_name[n] for n in set(named.values()))


def decode(content: bytes) -> list[tuple]:
    """``name, shape, dtype, values`` of one file: a length, a JSON header
    with offsets, and the raw values."""
    (size,) = struct.unpack("<Q", content[:8])
    data = memoryview(content)
    return sorted(((name, shape, *as_single(data[start:end], code)) for name, code, shape, start, end in layout(content[:8], content[8 : 8 + size])), key=lambda r: r[0])


def encode(rows: list[tuple]) -> bytes:
    """One file of ``name, shape, dtype, values`` rows; the reverse of decode."""
    header, parts, at = {}, [], 0
    known = {kind: (code, numpy_kind) for code, (kind, numpy_kind) in TYPES.items()}
    for name, shape, kind, values in sorted(rows, key=lambda r: r[0]):
        code, numpy_kind = known[kind]
        values = np.asarray(values, dtype=np.float32)
        if kind == "bfloat16":  # round to nearest, ties to even
            bits = values.view(np.uint32)
            values = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)
        raw = values.astype(numpy_kind).tobytes()
        header[name] = {"dtype": code, "shape": list(shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    text = json.dumps(header, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(parts)


def layout(head: bytes, text: bytes) -> list[tuple[str, str, list[int], int, int]]:
    """``name, type, shape, start, end`` of a file's tensors from its header;
    places count from the file's beginning."""
    (size,) = struct.unpack("<Q", head)
    told = {n: t for n, t in json.loads(text).items() if n != "__metadata__"}
    return [(n, t["dtype"], t["shape"], 8 + size + t["data_offsets"][0], 8 + size + t["data_offsets"][1]) for n, t in sorted(told.items(), key=lambda x: x[1]["data_offsets"])]


def as_single(raw: bytes | memoryview, code: str) -> tuple[str, np.ndarray]:
    """The table's name of a type, and values of it in single precision."""
    kind, numpy_kind = TYPES[code]
    values = np.frombuffer(raw, dtype=numpy_kind)
    if kind == "bfloat16":
        values = (values.astype(np.uint32) << 16).view(np.float32)
    return kind, values.astype(np.float32, copy=False)


def _batch(name: str, shape: list[int], kind: str, values: np.ndarray) -> pa.RecordBatch:
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shape], pa.list_(pa.int32())), pa.array([kind]), whole], names=["name", "shape", "dtype", "values"])


@dataclass
class Run(InputPartition):
    """Tensors that follow one another in a file."""

    path: str
    tensors: list

    def __init__(self, path: str, tensors: list):
        self.path, self.tensors = path, tensors


@dataclass
class Shards(WriterCommitMessage):
    """A task's files, and the names of the tensors in each."""

    files: list


class TensorReader(DataSourceReader):
    """Headers make the plan, a partition for each run of tensors of about
    ``part_bytes``; a task reads its ranges and holds a tensor at a time."""

    def __init__(self, paths: list[str], part_bytes: int):
        self.paths, self.part_bytes = paths, part_bytes

    def partitions(self) -> list[Run]:
        out = []
        for path in self.paths:
            store, place = remote.opened(path)
            with store.open_input_file(place) as f:
                head = f.read_at(8, 0)
                told = layout(head, f.read_at(struct.unpack("<Q", head)[0], 8))
            run, size = [], 0
            for tensor in told:
                n = tensor[4] - tensor[3]
                if run and size + n > self.part_bytes:
                    out.append(Run(path, run))
                    run, size = [], 0
                run.append(tensor)
                size += n
            if run:
                out.append(Run(path, run))
        return out or [Run("", [])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.tensors:
            return
        store, place = remote.opened(partition.path)
        with store.open_input_file(place) as f:
            for name, code, shape, start, end in partition.tensors:
                yield _batch(name, shape, *as_single(f.read_at(end - start, start), code))


class TensorWriter(DataSourceArrowWriter):
    """Tasks write rows by their ``shard``, in whose order they come, one held
    at a time; the index, written last, names all files. Those of attempts that failed are named by
    none, and what an earlier index named is removed after the new one is there."""

    def __init__(self, folder: str):
        self.folder, self.run = folder.rstrip("/"), uuid.uuid4().hex[:12]

    def _put(self, name: str, content: bytes) -> None:
        store, temporary, final = remote.place(f"{self.folder}/{name}", uuid.uuid4().hex)
        with store.open_output_stream(temporary) as out:
            out.write(content)
        remote.publish(store, temporary, final)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shards:
        attempt, done, held, at = TaskContext.get().taskAttemptId(), [], [], None

        def flush() -> None:
            if held:
                name = f"model-{at:05d}-{self.run}-{attempt}.safetensors"
                self._put(name, encode(held))
                done.append((name, [r[0] for r in held]))
                held.clear()

        for batch in iterator:
            for i in range(batch.num_rows):
                name, shape, kind, values, shard = (batch.column(c)[i] for c in ("name", "shape", "dtype", "values", "shard"))
                if shard.as_py() != at:
                    flush()
                    at = shard.as_py()
                held.append((name.as_py(), shape.as_py(), kind.as_py(), np.asarray(values.values, dtype=np.float32)))
        flush()
        return Shards(done)

    def commit(self, messages: list[Shards | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if not files:
            files = [(f"model-{self.run}.safetensors", [])]
            self._put(files[0][0], encode([]))
        store, place = remote.opened(f"{self.folder}/{INDEX}")
        before = set()
        if store.get_file_info(place).type != FileType.NotFound:
            with store.open_input_file(place) as f:
                before = set(json.loads(f.read())["weight_map"].values())
        self._put(INDEX, json.dumps({"weight_map": {n: name for name, held in files for n in held}}).encode())
        self._delete(before - {name for name, _ in files})

    def abort(self, messages: list[Shards | None]) -> None:
        self._delete({name for m in messages if m for name, _ in m.files})

    def _delete(self, files: set[str]) -> None:
        for name in files:
            store, place = remote.opened(f"{self.folder}/{name}")
            if store.get_file_info(place).type != FileType.NotFound:
                store.delete_file(place)


class TensorSource(DataSource):
    """``spark.read.format("safetensors")``, once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(json.loads(self.options["shards"]), int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options["path"])


def read_tensors(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """All tensors of a model folder; a task reads a run of them by ranges. In
    stores that tasks can't open it reads a file, which Spark holds whole."""
    found = shards(spark, folder)
    if all(map(remote.reachable, found)):
        spark.dataSource.register(TensorSource)
        return spark.read.format("safetensors").option("shards", json.dumps(found)).option("partBytes", part_bytes).load()

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield pd.DataFrame(decode(content), columns=["name", "shape", "dtype", "values"])

    return spark.read.format("binaryFile").load(found).select("content").mapInPandas(rows, SCHEMA)


def write_tensors(tensors: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> list[str]:
    """Writes shards and their index, names in order; the files. A shard has at
    most ``shard_bytes`` of values, or one tensor, and a task holds one shard;
    the driver holds names and sizes, as the index does, and no values. A model
    without tensors is one empty shard. The folder must be one that tasks can
    open."""
    spark, folder = tensors.sparkSession, folder.rstrip("/")
    if not remote.reachable(folder):
        raise ValueError(f"tasks can't open {folder!r}")
    told = tensors.select("name", (F.size("values").cast("long") * 4).alias("n")).orderBy("name").collect()
    twice = sorted({a["name"] for a, b in zip(told, told[1:]) if a["name"] == b["name"]})
    if twice:
        raise ValueError(f"tensors of one name: {twice[:5]}")
    numbered, filled = [], 0
    for r in told:
        if numbered and filled + r["n"] <= shard_bytes:
            numbered.append((r["name"], numbered[-1][1]))
        else:
            numbered.append((r["name"], numbered[-1][1] + 1 if numbered else 0))
            filled = 0
        filled += r["n"]
    number = spark.createDataFrame(numbered, "name string, shard int")
    ordered = tensors.select("name", "shape", "dtype", "values").join(F.broadcast(number), "name").repartitionByRange(min(numbered[-1][1] + 1, MOST_TASKS) if numbered else 1, "shard")
    spark.dataSource.register(TensorSource)
    ordered.sortWithinPartitions("shard", "name").write.format("safetensors").mode("append").save(folder)
    named = json.loads(get(spark, f"{folder}/{INDEX}"))["weight_map"].values()
    return sorted(set(named)) or [f.rsplit("/", 1)[1] for f in list_files(spark, f"{folder}/*", ".safetensors")]


def copy_others(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copies a model folder's other files: configuration and tokenizer."""
    done = []
    for f in list_files(spark, f"{source.rstrip('/')}/*", ""):
        name = f.rsplit("/", 1)[1]
        if not name.endswith((".safetensors", ".safetensors.index.json")):
            copy(spark, f, f"{target.rstrip('/')}/{name}")
            done.append(name)
    return done
