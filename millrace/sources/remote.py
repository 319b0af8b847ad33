"""Files as tasks open them, by ranges, where a store can be reached from Python.

Spark's own readers go through Hadoop and reach every store. Tasks that copy
files or write formats that Spark has no writer for use Arrow's file systems:
local or mounted folders, S3, Google storage, Azure and HDFS.
"""

from __future__ import annotations

import re

from pyarrow import fs

#: Schemes as Hadoop names them, and as Arrow does.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


def reachable(path: str) -> bool:
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return path.startswith("/") if scheme is None else scheme[1].lower() in SCHEMES


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    if not reachable(path):
        raise ValueError(f"tasks can't open {path!r}")
    if scheme.lower() == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme.lower()]}:{rest}")


def publish(store: fs.FileSystem, temporary: str, path: str) -> None:
    """A file under its name, once it is whole."""
    if temporary != path:
        store.move(temporary, path)


def place(path: str, token: str) -> tuple[fs.FileSystem, str, str]:
    """Store, a name to write to and the name to publish it by. Object stores
    show a file only when it is closed; elsewhere it has a hidden name till then."""
    store, target = opened(path)
    folder, name = target.rsplit("/", 1)
    if isinstance(store, (fs.LocalFileSystem, fs.HadoopFileSystem)):
        store.create_dir(folder, recursive=True)
        return store, f"{folder}/_{name}.{token}", target
    return store, target, target
