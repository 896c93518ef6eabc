"""A keyed table that grows by loads: runs per bucket of keys, merged level by level.

A load is reduced to one row per key and written as a run in the buckets that its keys fall in. Where a bucket
holds ``fanout`` runs of one level, they are merged into one run of the next; other buckets are not
touched. So a row is rewritten once per level, and a reader opens at most ``fanout - 1`` runs per level and bucket,
with about log(loads) levels. What is valid is named by a manifest, written after the runs: a load
that fails leaves no trace, and one that is repeated changes nothing. One writer at a time.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tracehold.session import delete_folder, list_folder, read_text, write_text

_BUCKET = "_bucket"


class MergeStore:
    """Rows with one row per ``keys``; ``merge`` reduces rows of any loads, in any order, to that."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame],
                 buckets: int = 16, fanout: int = 4) -> None:
        """``buckets`` holds for a new store; choose it so that a bucket is a file of good size (some 100 MB)."""
        self.spark, self.path, self.keys, self.merge = spark, path.rstrip("/"), list(keys), merge
        self.buckets, self.fanout = buckets, fanout

    # the manifest: version, buckets, schema, loads, runs [bucket, level, folder]

    def _versions(self) -> list[int]:
        names = list_folder(self.spark, self.path)
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict:
        versions = self._versions() if version is None else [version]
        if not versions:
            return {"version": 0, "buckets": self.buckets, "schema": None, "loads": [], "runs": []}
        return json.loads(read_text(self.spark, f"{self.path}/manifest-{versions[-1]}.json"))

    def _commit(self, manifest: dict) -> None:
        """Name the new runs; the runs of the manifest before stay for its readers, older ones go."""
        version = manifest["version"]
        write_text(self.spark, f"{self.path}/manifest-{version}.json", json.dumps(manifest))
        older = [v for v in self._versions() if v < version]
        kept = {folder for _, _, folder in manifest["runs"]}
        for v in older[-1:]:
            kept |= {folder for _, _, folder in self._manifest(v)["runs"]}
        for v in older[:-1]:
            for folder in {folder for _, _, folder in self._manifest(v)["runs"]} - kept:
                delete_folder(self.spark, f"{self.path}/{folder}")
            delete_folder(self.spark, f"{self.path}/manifest-{v}.json")

    # runs

    def _bucket(self, count: int) -> Column:
        """The task that ``repartition(count, *keys)`` sends a row to, so that a task has the rows of one bucket."""
        return F.pmod(F.hash(*self.keys), F.lit(count)).cast("int")

    def _write(self, rows: DataFrame, folder: str, level: int, count: int) -> list[list]:
        """Write merged rows, dealt by their keys, as one run per bucket; returns the runs."""
        dealt = rows.withColumn(_BUCKET, self._bucket(count))
        dealt.write.partitionBy(_BUCKET).mode("overwrite").parquet(f"{self.path}/{folder}")
        names = [n for n in list_folder(self.spark, f"{self.path}/{folder}") if n.startswith(f"{_BUCKET}=")]
        return [[int(n.split("=")[1]), level, f"{folder}/{n}"] for n in names]

    def _frame(self, manifest: dict, runs: list[list]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for _, _, folder in runs])

    def add(self, rows: DataFrame, load: int, merged: bool = False) -> bool:
        """Add the rows of a load; False if that load was added before. ``merged``: one row per key already."""
        manifest = self._manifest()
        if load in manifest["loads"]:
            return False
        rows = rows if merged else self.merge(rows)
        number, count = manifest["version"] + 1, manifest["buckets"]
        manifest["schema"] = manifest["schema"] or json.loads(rows.schema.json())
        made = self._write(rows.repartition(count, *self.keys), f"run-{number}-0", 0, count)
        manifest["runs"] += made
        level = 0
        while True:
            held = defaultdict(list)
            for run in manifest["runs"]:
                if run[1] == level:
                    held[run[0]].append(run)
            due = [run for runs in held.values() if len(runs) >= self.fanout for run in runs]
            if not due:
                break
            level += 1
            # a key is in few runs of a level, so rows go to their buckets first and are merged there, in one shuffle
            dealt = self._frame(manifest, due).repartition(count, *self.keys)
            new = self._write(self.merge(dealt), f"run-{number}-{level}", level, count)
            manifest["runs"] = [run for run in manifest["runs"] if run not in due] + new
            made += new
        self._commit({**manifest, "version": number, "loads": [*manifest["loads"], load]})
        for run in made:  # merged on within this load
            if run not in manifest["runs"]:
                delete_folder(self.spark, f"{self.path}/{run[2]}")
        return True

    def read(self) -> DataFrame:
        """All rows so far, one per key."""
        manifest = self._manifest()
        if not manifest["schema"]:
            raise ValueError(f"nothing was added to {self.path}")
        if not manifest["runs"]:
            return self.spark.createDataFrame([], T.StructType.fromJson(manifest["schema"]))
        return self.merge(self._frame(manifest, manifest["runs"]))

    def loads(self) -> list[int]:
        """The loads that were added."""
        return self._manifest()["loads"]

    def runs(self) -> list[tuple[int, int, str]]:
        """(bucket, level, folder) of the runs that a reader opens."""
        return [tuple(run) for run in self._manifest()["runs"]]

    def copy_to(self, path: str, buckets: int | None = None) -> MergeStore:
        """A new store with one run per bucket and the same loads; later loads go on there."""
        manifest, rows = self._manifest(), self.read()
        count = buckets or manifest["buckets"]
        other = MergeStore(self.spark, path, self.keys, self.merge, count, self.fanout)
        level = max((run[1] for run in manifest["runs"]), default=0)
        runs = other._write(rows.repartition(count, *self.keys), "run-1-0", level, count)
        other._commit({"version": 1, "buckets": count, "schema": manifest["schema"], "loads": manifest["loads"], "runs": runs})
        return other
