"""Tables whose versions a manifest names: a commit is one file that appears whole, or not at all, and only once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this commit is visible."""


class Manifest:
    """A series of numbered commits in a shared folder, each a small JSON object.

    A commit is written beside the others under a name of its own and renamed
    to its number last; the rename is refused where the number exists. So of
    two writers that read the same state one succeeds (compare and set), and a
    reader never sees half a commit. Works on every file system that Spark
    reads, through Hadoop's own rename.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self, path):
        return path.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of all commits, ascending."""
        folder = self._at("commits")
        system = self._system(folder)
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """The latest commit, or one by number: (number, content); (-1, {}) before the first."""
        if version is None:
            every = self.versions()
            if not every:
                return -1, {}
            version = every[-1]
        path = self._at(f"commits/{version:012d}.json")
        stream = self._system(path).open(path)
        try:
            return version, json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, expected: int, content: dict) -> int:
        """Make ``content`` the commit after ``expected``; Conflict where that place is taken."""
        target, own = self._at(f"commits/{expected + 1:012d}.json"), self._at(f"pending/{uuid.uuid4().hex}.json")
        system = self._system(own)
        out = system.create(own, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        system.mkdirs(target.getParent())
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(own, target, options)
        except Exception as error:
            system.delete(own, False)
            if system.exists(target):
                raise Conflict(f"commit {expected + 1} exists") from error
            raise
        return expected + 1

    def drop(self, name: str) -> None:
        """Delete a folder that no reader of a present version needs."""
        path = self._at(name)
        self._system(path).delete(path, True)


class GuardedTables:
    """Several Parquet tables whose new versions appear together.

    Every commit names the files of each table and the state that it was made
    from; ``apply`` fails with Conflict, and leaves no visible trace, where
    another commit came between.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.manifest = spark, Manifest(spark, path)

    def state(self) -> tuple[int, dict]:
        """(commit number, its content: tables and notes)."""
        version, content = self.manifest.read()
        return version, content or {"tables": {}, "notes": {}}

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a commit."""
        _, content = self.manifest.read(version)
        return self.spark.read.parquet(*[f"{self.manifest.path}/{part}" for part in content["tables"][name]])

    def apply(self, version: int, append: dict[str, DataFrame], replace: dict[str, DataFrame] | None = None, notes: dict | None = None) -> int:
        """Add rows to some tables and replace others in one commit on top of ``version``."""
        _, content = self.manifest.read(version) if version >= 0 else (-1, {"tables": {}, "notes": {}})
        tables = {k: list(v) for k, v in content["tables"].items()}
        for name, rows in {**append, **(replace or {})}.items():
            part = f"{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.manifest.path}/{part}")
            tables[name] = [part] if replace and name in replace else [*tables.get(name, []), part]
        return self.manifest.commit(version, {"tables": tables, "notes": {**content["notes"], **(notes or {})}})
