"""A log of versions in a folder that all executors share: small JSON files, numbered, each made visible by one rename.

A version that is torn or not there doesn't count, so that what it would have named stays invisible; two writers of one version can't both succeed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class VersionLog:
    """The versions below ``root``; facts are dictionaries that JSON can hold."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        stream = self._fs().open(self._path(name))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def latest(self) -> tuple[int, dict]:
        """(the last number that is taken, the facts of the last whole version); (0, {}) where there is none. A torn version keeps its number."""
        found = self._fs().globStatus(self._path("*.json")) or ()
        names = sorted((f.getPath().getName() for f in found), reverse=True)
        last = int(names[0].split(".")[0]) if names else 0
        return last, next((facts for facts in map(self._read, names) if facts is not None), {})

    def commit(self, version: int, facts: dict) -> None:
        """Make ``facts`` the version; raises FileExistsError where another writer was first."""
        fs, draft, name = self._fs(), self._path(f".draft-{uuid.uuid4().hex}"), self._path(f"{version:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
        out.close()
        if fs.exists(name) or not fs.rename(draft, name):
            fs.delete(draft, False)
            raise FileExistsError(f"version {version} of {self.root} is there already")

    def drop(self, names: list[str]) -> None:
        """Delete folders below the root that no version names any more."""
        fs = self._fs()
        for name in names:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)
