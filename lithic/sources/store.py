"""A versioned table on any file system: written aside, committed by one rename.

Layout under the table's folder: ``parts/<name>/rows`` and ``parts/<name>/keys``
hold what a write brings and the keys that it replaces; ``versions/<number>`` is a
small JSON list of the parts of a version, in order. A key's rows are those of the
last part that lists the key. A version is complete before it has a name, and
readers go by names, so they see one version, whole: a writer that stops before
its rename has changed nothing. The rename fails where the name is taken: of two
writers that start from one version, the second looks at what has come between. If
that has touched its keys it is refused, else its parts follow and it tries the
next number. Parts are few between compactions, keys and rows stay in Spark.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.saved import delete

#: parts of a version from which a write compacts the table
MOST_PARTS = 16


class Conflict(RuntimeError):
    """Another writer has changed the same keys."""


class Store:
    """The versioned table under ``path``, whose rows are replaced by the values of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # ---- versions

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        """The number of the newest version; 0 without any."""
        return max(self.versions(), default=0)

    def parts(self, version: int) -> list[str]:
        if not version:
            return []
        stream = self._fs.open(self._at(self._name(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))["parts"]
        finally:
            stream.close()

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/{version:020d}"

    def _publish(self, version: int, parts: list[str]) -> bool:
        """Give a version its name, in one step; False if the name is taken."""
        aside = self._at(f"{self.path}/aside-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        self._fs.mkdirs(self._at(f"{self.path}/versions"))
        qualified = self._fs.makeQualified(aside)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(qualified, self._fs.makeQualified(self._at(self._name(version))), plain)  # without leave to overwrite
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    # ---- reading

    def _keys(self, parts: list[str]) -> DataFrame:
        each = [self.spark.read.parquet(f"{self.path}/parts/{p}/keys").withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
        return reduce(DataFrame.unionByName, each)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        parts = self.parts(self.latest() if version is None else version)
        if not parts:
            raise ValueError(f"there is no version under {self.path}")
        owner = self._keys(parts).groupBy(F.col(self.key).alias("_key")).agg(F.max("_part").alias("_owner"))
        each = [self.spark.read.parquet(f"{self.path}/parts/{p}/rows").withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
        return rows.join(owner, F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_owner"))).drop("_part", "_key", "_owner")

    # ---- writing

    def write_aside(self, rows: DataFrame, keys: DataFrame | None = None) -> str:
        """A new part with ``rows``, which replaces their keys, or all ``keys``, once it is committed."""
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/parts/{part}/rows")
        keys = self.spark.read.schema(rows.schema).parquet(f"{self.path}/parts/{part}/rows") if keys is None else keys
        keys.select(self.key).distinct().write.parquet(f"{self.path}/parts/{part}/keys")
        return part

    def commit(self, part: str, base: int) -> int:
        """Make ``part``, written on the ground of version ``base``, part of a new version; its number."""
        while True:
            latest = self.latest()
            between = [p for p in self.parts(latest) if p not in set(self.parts(base))]
            if latest != base and between:
                mine = self.spark.read.parquet(f"{self.path}/parts/{part}/keys").select(F.col(self.key).alias("_key"))
                if not self._keys(between).join(mine, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi").isEmpty():
                    raise Conflict(f"version {latest} has changed keys of a write based on version {base}")
            if self._publish(latest + 1, [*self.parts(latest), part]):
                return latest + 1

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> int:
        """The rows of all keys in ``rows`` (and ``keys``) replaced; other keys stay. The number of the new version."""
        base = self.latest()
        version = self.commit(self.write_aside(rows, keys), base)
        return self.compact() if len(self.parts(version)) > MOST_PARTS else version

    def append_new(self, rows: DataFrame) -> int:
        """Each row whose key the table does not have, once; what is there is never written again."""
        while True:
            base = self.latest()
            once = rows.dropDuplicates([self.key])
            if base:
                there = self._keys(self.parts(base)).select(F.col(self.key).alias("_key"))
                once = once.join(there, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
            try:
                return self.commit(self.write_aside(once), base)
            except Conflict:  # another writer has brought some of them
                continue

    def compact(self) -> int:
        """The newest version in one part. Given up if another writer comes between."""
        base = self.latest()
        part = self.write_aside(self.read(base))
        return base + 1 if self._publish(base + 1, [part]) else self.latest()

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions, and parts that none of them has; how many parts go. Not while others write."""
        versions = self.versions()
        live = {p for v in versions[-keep:] for p in self.parts(v)}
        for v in versions[:-keep]:
            delete(self.spark, self._name(v))
        folder = self._at(f"{self.path}/parts")
        gone = [f.getPath().getName() for f in self._fs.listStatus(folder) if f.getPath().getName() not in live] if self._fs.exists(folder) else []
        for part in gone:
            delete(self.spark, f"{self.path}/parts/{part}")
        return len(gone)
