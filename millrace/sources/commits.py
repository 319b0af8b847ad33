"""A commit log: data is there once a manifest names it, and not before.

Writers put data into new folders under ``path/data`` and then create one
manifest, ``path/commits/<number>``, that names them. A manifest is created only
if its number is free and holds a digest of its content, so that a broken one
counts as none; nothing is renamed, which object stores can't do as a whole.
Readers take the folders of all manifests up to a number: a snapshot. Folders
that no manifest names are what a lost writer left.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from millrace.sources.shared import _file_system, delete, folders, names


class Conflict(RuntimeError):
    """Another writer has taken the number."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _taken(self) -> list[int]:
        return sorted(int(n) for n in names(self.spark, f"{self.path}/commits") if re.fullmatch(r"\d{12}", n))

    def _load(self, number: int) -> dict | None:
        target, fs = _file_system(self.spark, f"{self.path}/commits/{number:012d}")
        stream = fs.open(target)
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            digest, body = raw.decode("utf-8").split("\n", 1)
            return json.loads(body) if digest == hashlib.sha256(body.encode("utf-8")).hexdigest() else None
        except ValueError:
            return None

    def manifests(self, upto: int | None = None) -> list[tuple[int, dict]]:
        """Number and content of each whole manifest, in order."""
        told = ((n, self._load(n)) for n in self._taken() if upto is None or n <= upto)
        return [(n, m) for n, m in told if m is not None]

    def last(self) -> tuple[int, dict] | None:
        for number in reversed(self._taken()):
            found = self._load(number)
            if found is not None:
                return number, found
        return None

    def new(self, kind: str, at: int = 0) -> str:
        """A folder for data, as manifests name it; names sort by ``at``."""
        return f"{kind}-{at:012d}-{uuid.uuid4().hex}"

    def place(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def commit(self, manifest: dict, after: int | None = None) -> int:
        """Creates the manifest behind the one that the writer has seen last
        (``after``), or behind the last there is; its number."""
        taken = self._taken()
        if after is not None and taken and self.last() and self.last()[0] != after:
            raise Conflict(f"{self.path} was committed to by another writer")
        number = (taken[-1] if taken else 0) + 1
        body = json.dumps(manifest, sort_keys=True)
        target, fs = _file_system(self.spark, f"{self.path}/commits/{number:012d}")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            raise Conflict(f"commit {number} of {self.path} is there already") from e
        try:
            out.write(f"{hashlib.sha256(body.encode('utf-8')).hexdigest()}\n{body}".encode())
        finally:
            out.close()
        return number

    def snapshot(self, kind: str, upto: int | None = None) -> list[str]:
        """Folders of a kind, in the order in which they were committed."""
        return [self.place(name) for _, m in self.manifests(upto) for name in m.get(kind, [])]

    def vacuum(self) -> int:
        """Removes folders that no manifest names; only while nothing writes."""
        named = {name for _, m in self.manifests() for found in m.values() if isinstance(found, list) for name in found}
        lost = [f for f in folders(self.spark, f"{self.path}/data") if f not in named]
        for name in lost:
            delete(self.spark, self.place(name))
        return len(lost)
