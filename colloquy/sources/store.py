"""Tables as snapshots in a folder that all workers share. A commit writes every changed table to a new folder and then replaces one small manifest, so that readers
see all of a commit or nothing, and a failed one leaves the old state. Old snapshots stay until `vacuum`, which makes backups and restores cheap."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> None:
        """Written beside its place and renamed onto it."""
        tmp = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(tmp)
        out.write(json.dumps(value).encode())
        out.close()
        final = self._path(f"{self.root}/{name}")
        if self._fs.exists(final):
            self._fs.delete(final, False)
        if not self._fs.rename(tmp, final):
            raise OSError(f"{name} was not replaced")

    def manifest(self) -> dict:
        return self._read("manifest.json") or {"version": 0, "tables": {}}

    def table(self, name: str) -> DataFrame:
        at = self.manifest()["tables"].get(name)
        if at is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{at}")

    def names(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def commit(self, changed: dict[str, DataFrame], unique: dict[str, list[str]] | None = None) -> int:
        """Writes all tables of changed, or none. unique: columns that must be a key, else ValueError and the old state stays."""
        now = self.manifest()
        staged = {name: f"{name}/{uuid.uuid4().hex}" for name in changed}
        try:
            for name, df in changed.items():
                df.write.parquet(f"{self.root}/{staged[name]}")
                keys = (unique or {}).get(name)
                if keys and not self.spark.read.parquet(f"{self.root}/{staged[name]}").groupBy(*keys).count().where("count > 1").isEmpty():
                    raise ValueError(f"{name}: {keys} is no key")
        except BaseException:
            for at in staged.values():
                self._fs.delete(self._path(f"{self.root}/{at}"), True)
            raise
        self._write("manifest.json", {"version": now["version"] + 1, "tables": now["tables"] | staged})
        return now["version"] + 1

    def backup(self, label: str) -> None:
        self._write(f"backup-{label}.json", self.manifest())

    def backups(self) -> list[str]:
        return sorted(s.getPath().getName()[7:-5] for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("backup-"))

    def valid(self, label: str) -> bool:
        b = self._read(f"backup-{label}.json")
        return b is not None and all(self._fs.exists(self._path(f"{self.root}/{at}/_SUCCESS")) for at in b["tables"].values())

    def restore(self, label: str) -> None:
        """The state of a backup; the state before is kept as backup `before-LABEL`."""
        if not self.valid(label):
            raise ValueError(f"backup {label} is missing or broken")
        self.backup(f"before-{label}")
        self._write("manifest.json", self._read(f"backup-{label}.json") | {"version": self.manifest()["version"] + 1})

    def drop_backup(self, label: str) -> None:
        self._fs.delete(self._path(f"{self.root}/backup-{label}.json"), False)

    def vacuum(self) -> None:
        """Deletes the snapshots that neither the manifest nor a backup names."""
        used = set(self.manifest()["tables"].values())
        for label in self.backups():
            used |= set(self._read(f"backup-{label}.json")["tables"].values())
        for t in self._fs.listStatus(self._path(self.root)):
            if t.isDirectory():
                for s in self._fs.listStatus(t.getPath()):
                    if f"{t.getPath().getName()}/{s.getPath().getName()}" not in used:
                        self._fs.delete(s.getPath(), True)


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with each missing column added as NULL of its type; compact_text, an older name of distilled_text, is taken over where that is NULL."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    if "compact_text" in df.columns and "distilled_text" in df.columns:
        df = df.withColumn("distilled_text", F.coalesce("distilled_text", "compact_text")).drop("compact_text")
    return df


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
