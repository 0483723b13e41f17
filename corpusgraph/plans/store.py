"""Versioned snapshots on any Hadoop file system: tables are written, then one manifest appears.

A version is a manifest file that names the folder of each table; a table that a commit doesn't
give keeps its folder, so nothing is copied. Manifests are created and never overwritten: of two
writers of the same version one fails and commits again on top of the other. The last
``RETAIN`` versions stay readable, but for commits that purge, which is what content asks for that
the gate refuses now.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.gate import SECRET
from corpusgraph.schema import SCHEMA_VERSION

RETAIN = 3
ATTEMPTS = 5
#: Columns that must be empty in rows that the gate calls secret.
CONTENT = ("content", "body", "preview", "calls")


class ConflictError(RuntimeError):
    """Other writers kept committing while this one tried."""


class Store:
    """Tables of one project. Readers see the version a manifest names, whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.folder, *parts)))

    def _names(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @property
    def state(self) -> dict:
        names = [n for n in self._names() if n.startswith("manifest-")]
        if names:
            state = self._load(names[-1])
        elif self._fs.exists(self._path("_CURRENT")):
            state = self._upcast(self._load("_CURRENT"))
        else:
            state = {"version": 0, "schema": SCHEMA_VERSION, "tables": {}, "meta": {}}
        if state["schema"] > SCHEMA_VERSION:
            raise ValueError("the store was written by a newer release")
        return state

    def _upcast(self, old: dict) -> dict:
        """Schema 1 had one folder a version, named by a pointer file."""
        folder = f"v{old['version']}"
        return {"version": old["version"], "schema": SCHEMA_VERSION, "tables": {n: f"{folder}/{n}" for n in self._names(folder)}, "meta": old["meta"]}

    def read(self, name: str) -> DataFrame | None:
        at = self.state["tables"].get(name)
        return None if at is None else self.spark.read.parquet(f"{self.folder}/{at}")

    def refused(self, df: DataFrame) -> DataFrame:
        """Rows labelled secret that carry content all the same."""
        held = [F.size(c) > 0 if t.startswith("array") else F.octet_length(c) > 0 for c, t in df.dtypes if c in CONTENT]
        any_held = F.lit(False)
        for h in held:
            any_held = any_held | F.coalesce(h, F.lit(False))
        return df.filter((F.col("label") == SECRET) & any_held)

    def commit(self, tables: dict[str, DataFrame], meta: dict | None = None, *, purge: bool = False) -> int:
        """Write a version; tables that aren't given are carried over. Returns its number."""
        made = {}
        for name, df in tables.items():
            made[name] = f"tables/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{made[name]}")
        for name, df in tables.items():
            if "label" in df.columns and not self.refused(self.spark.read.parquet(f"{self.folder}/{made[name]}")).isEmpty():
                for at in made.values():
                    self._fs.delete(self._path(at), True)
                raise ValueError(f"refusing to store content of secret rows of {name}")
        for _ in range(ATTEMPTS):
            old = self.state
            state = {"version": old["version"] + 1, "schema": SCHEMA_VERSION, "tables": {**old["tables"], **made}, "meta": {**old["meta"], **(meta or {})}}
            if self._create(f"manifest-{state['version']:010d}", state):
                self._retire(1 if purge else RETAIN, purge)
                return state["version"]
        raise ConflictError("another writer kept committing")

    def _create(self, name: str, state: dict) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.create(self._path(name), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception) or self._fs.exists(self._path(name)):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        return True

    def _retire(self, keep: int, purge: bool) -> None:
        """Delete what none of the last ``keep`` manifests names; others' uncommitted tables stay."""
        names = [n for n in self._names() if n.startswith("manifest-")]
        gone = [self._load(n) for n in names[:-keep]]
        held = {at for n in names[-keep:] for at in self._load(n)["tables"].values()}
        for n, state in zip(names, gone, strict=False):
            for at in set(state["tables"].values()) - held:
                self._fs.delete(self._path(at), True)
            self._fs.delete(self._path(n), False)
        if gone or purge:
            for name in self._names():
                if name == "_CURRENT" or (name.startswith("v") and not any(at.startswith(f"{name}/") for at in held)):
                    self._fs.delete(self._path(name), True)

    def meta(self, key: str, default=None):
        return self.state["meta"].get(key, default)
