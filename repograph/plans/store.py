"""The graph on disk: tables of one version in a folder, and a pointer to the version that counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "files": "id string, path string, language string, hash string, size_bytes long, tracked boolean, last_indexed_at string",
    "seen": "id string, path string, language string, hash string, size_bytes long, tracked boolean, last_indexed_at string",
    "facts": "path string, fact string, name string, full_name string, kind string, start_line int, end_line int, visibility string, exported boolean, target string, hint string",
    "symbols": "id string, name string, full_name string, kind string, language string, file_path string, start_line int, end_line int, visibility string, exported boolean",
    "projects": "id string, name string, path string, language string, kind string",
    "packages": "id string, name string, version string, ecosystem string, dependency_kind string",
    "contains_file": "project_id string, path string",
    "references_project": "src string, dst string",
    "uses_package": "src string, dst string",
    "imports_package": "file_path string, package_id string",
    "references": "src string, dst string, name string",
    "supertypes": "src string, dst string, kind string",
}


class Store:
    """Tables below a folder that all executors share. A version is complete before the pointer names it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pinned: str | None = None

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """The version that counts, or the one this store is held at."""
        if self.pinned:
            return self.pinned
        fs, at = self._fs(), self._path("CURRENT")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytearray(stream.readAllBytes()).decode().strip() or None
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        """A table of the current version; without a version, an empty one."""
        now = self.version()
        if now is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.folder}/{now}/{table}")

    def begin(self) -> str:
        return f"v-{uuid.uuid4().hex}"

    def write(self, version: str, table: str, df: DataFrame) -> DataFrame:
        """Writes a table of a version that doesn't count yet; what was written."""
        path = f"{self.folder}/{version}/{table}"
        df.select(*[c.split(" ")[0] for c in TABLES[table].split(", ")]).write.parquet(path)
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def commit(self, version: str) -> None:
        """Makes a version the one that counts, by a rename of the pointer, and removes all but it and the one before."""
        fs, before = self._fs(), self.version()
        new = self._path(f"CURRENT-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        if fs.exists(self._path("CURRENT")):
            fs.delete(self._path("CURRENT"), False)
        if not fs.rename(new, self._path("CURRENT")):
            raise OSError(f"{self.folder}/CURRENT was not replaced")
        for status in fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in (version, before):
                fs.delete(status.getPath(), True)

    def clear(self) -> None:
        fs = self._fs()
        if fs.exists(self._path("")):
            fs.delete(self._path(""), True)
