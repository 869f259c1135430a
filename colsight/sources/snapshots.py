"""Saved tables in versions: each save writes a folder of its own, and one small file commits it.

A version is first written whole, then a manifest with the next number is put in place by a rename, which a file system
does at once or not at all. Readers take the manifest of the largest number, so they see the old table or the new one, and
a table may be saved from a plan that reads the version before it. Two saves at a time get different numbers.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_MANIFEST = re.compile(r"manifest-(\d+)\.json")

#: Versions that stay: the last one, and those before it that tables restored earlier may still read.
KEPT = 2


class VersionFolder:
    """Small files of a folder, through the file system that Spark itself writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self.name = spark, folder.rstrip("/")
        self._store = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.name}/{name}" if name else self.name)

    def names(self) -> list[str]:
        if not self._store.exists(self._path("")):
            return []
        return [s.getPath().getName() for s in self._store.listStatus(self._path(""))]

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for m in map(_MANIFEST.fullmatch, self.names()) if m)

    def read(self, version: int) -> dict:
        rows = self._spark.read.text(f"{self.name}/manifest-{version}.json", wholetext=True).collect()
        return json.loads(rows[0].value)

    def commit(self, version: int, content: dict) -> bool:
        """Puts the manifest in place; False if that number is taken."""
        waiting, place = self._path(f".waiting-{uuid.uuid4().hex}"), self._path(f"manifest-{version}.json")
        out = self._store.create(waiting, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        # A rename onto a file is refused or, on a local disk, replaces it: look first.
        if self._store.exists(place) or not self._store.rename(waiting, place):
            self._store.delete(waiting, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self._store.delete(self._path(name), True)


def save_version(df: DataFrame, folder: str, name: str) -> int:
    """Writes ``df`` with its display name as the next version of ``folder`` and returns its number.

    If the write fails or is cut short, the versions before stay as they are. Of the older versions the last ones are
    kept for tables that were restored from them, the others are removed.
    """
    place = VersionFolder(df.sparkSession, folder)
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{place.name}/{data}")
    version = max(place.versions(), default=0) + 1
    while not place.commit(version, {"data": data, "name": name}):
        version += 1
    for old in place.versions()[:-KEPT]:
        gone = place.read(old)["data"]
        place.remove(f"manifest-{old}.json")
        place.remove(gone)
    return version


def load_version(spark: SparkSession, folder: str, version: int | None = None) -> tuple[DataFrame, str] | None:
    """The table and name of a version, the last one by default; None if there is none."""
    place = VersionFolder(spark, folder)
    known = place.versions()
    wanted = version if version is not None else max(known, default=None)
    if wanted not in known:
        return None
    content = place.read(wanted)
    return spark.read.parquet(f"{place.name}/{content['data']}"), content["name"]
