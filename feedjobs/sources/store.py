"""The stored feed: buckets by hash of id, in versions that are committed as a whole.

A version is a folder with the buckets that were rewritten for it, small tables beside them (run, status, verdicts) and
a list that says for every bucket which version wrote it last. The list is written last and, as Spark commits a
written table by a marker file, a version counts from the moment that its list has the marker: a run that reads a feed
and writes it back to the same path and breaks off in between leaves the version before it as it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FeedStore:
    """Feed items by id under a path. `buckets` is fixed for a path; `keep` versions are kept, two at least, so
    that the last batch of a stream can be repeated from the version before it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, max(2, keep)
        self._lists: dict[int, list] = {}
        self._runs: dict[int, dict] = {}

    # ------------------------------------------------------------------ files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _at(self, version: int, table: str) -> str:
        return f"{self.path}/version={version}/{table}"

    # ------------------------------------------------------------------ reading

    def versions(self) -> list[int]:
        """The committed versions in order."""
        numbers = sorted(int(n.removeprefix("version=")) for n in self._names(self.path) if n.startswith("version="))
        return [n for n in numbers if self._exists(f"{self._at(n, 'buckets')}/_SUCCESS")]

    def latest(self, before: int | None = None) -> int | None:
        found = [n for n in self.versions() if before is None or n < before]
        return found[-1] if found else None

    def _list(self, version: int | None) -> list:
        """(bucket, version that wrote it, rows) of a version: a row for each bucket."""
        if version is None:
            return []
        if version not in self._lists:
            self._lists[version] = [tuple(r) for r in self.spark.read.schema("bucket int, version int, n long").parquet(self._at(version, "buckets")).collect()]
        return self._lists[version]

    def written(self, version: int | None) -> dict[int, int]:
        """For each bucket with rows the version that wrote it."""
        return {b: v for b, v, _ in self._list(version)}

    def items(self, version: int | None, schema: T.StructType, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version; with `buckets`, only theirs."""
        wanted = None if buckets is None else set(buckets)
        folders = [f"{self._at(v, 'items')}/bucket={b}" for b, v in sorted(self.written(version).items()) if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def schema(self, version: int | None) -> T.StructType | None:
        """The columns of the items of a version, as its writer declared them."""
        return T.StructType.fromJson(self._run(version)["schema"]) if version is not None else None

    def now(self, version: int | None) -> datetime | None:
        """The time of the run that wrote a version."""
        return self._run(version)["generated_at"] if version is not None else None

    def _run(self, version: int) -> dict:
        if version not in self._runs:
            row = self.spark.read.parquet(self._at(version, "run")).first()
            self._runs[version] = {**row.asDict(), "schema": json.loads(row["schema"]), "generated_at": row["generated_at"].replace(tzinfo=UTC)}
        return self._runs[version]

    def table(self, version: int | None, name: str) -> DataFrame | None:
        """A table beside the items, if the version has it."""
        return self.spark.read.parquet(self._at(version, name)) if version is not None and self._exists(self._at(version, name)) else None

    def bucket(self, id_: Column | str = "id") -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------------ writing

    def commit(self, version: int, rows: DataFrame, now: datetime, touched: Iterable[int] | None = None, base: int | None = None, tables: Mapping[str, DataFrame] | None = None, retain_days: int = 45) -> None:
        """Write a version. rows: all rows of the `touched` buckets (of all buckets, if None); the others are those of
        version `base`. A version of that number that was begun or written before is replaced."""
        self._delete(f"{self.path}/version={version}")
        self._lists.pop(version, None), self._runs.pop(version, None)
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(self._at(version, "items"))
        there = []
        if any(n.startswith("bucket=") for n in self._names(self._at(version, "items"))):
            anew = self.spark.read.schema("bucket int").parquet(self._at(version, "items")).groupBy("bucket").count()
            there = [(r["bucket"], version, r["count"]) for r in anew.collect()]
        kept = [] if touched is None else [x for x in self._list(base) if x[0] not in set(touched)]
        listed = sorted([*kept, *there])
        run = self.spark.createDataFrame([(now, retain_days, sum(n for _, _, n in listed), rows.schema.json())], "generated_at timestamp, retain_days int, count long, schema string")
        for name, df in {"run": run.coalesce(1), **(tables or {})}.items():
            df.write.mode("overwrite").parquet(self._at(version, name))
        self.spark.createDataFrame(listed, "bucket int, version int, n long").coalesce(1).write.parquet(self._at(version, "buckets"))
        self._tidy(version)

    def _tidy(self, newest: int) -> None:
        """Remove what no kept version reads: uncommitted versions before the newest, and buckets written anew since."""
        committed = [v for v in self.versions() if v <= newest]
        kept = committed[-self.keep :]
        used = {(v, b) for k in kept for b, v in self.written(k).items()}
        for name in self._names(self.path):
            v = int(name.removeprefix("version=")) if name.startswith("version=") else newest
            if v >= newest or v in kept:
                continue
            if not any(u == v for u, _ in used):
                self._delete(f"{self.path}/{name}")
                continue
            for table in self._names(f"{self.path}/{name}"):
                if table != "items":
                    self._delete(f"{self.path}/{name}/{table}")
            for b in self._names(self._at(v, "items")):
                if b.startswith("bucket=") and (v, int(b.removeprefix("bucket="))) not in used:
                    self._delete(f"{self._at(v, 'items')}/{b}")
