"""Versioned Parquet tables: a folder of data files and one commit file per version.

A version is what its commit file and those before it say: files added and files removed.
Data files are written first and are in no version until the commit file is moved into
place, which fails if another writer took that number.  Nothing is deleted by a write, so a
failed one leaves the version before it whole, and old versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import materialize

# Attempts to take a version number while other writers commit files that do not concern ours.
ATTEMPTS = 20
_LOG = ("version long, operation string, added array<struct<file: string, n: long, low: map<string,string>, high: map<string,string>>>, "
        "removed array<string>")


class ConcurrentChange(RuntimeError):
    """Another writer changed files that this write read."""


@dataclass(frozen=True)
class VersionedTable:
    """A table at ``path``; ``ranged`` columns have their least and greatest value kept per file, as text or numbers."""

    spark: SparkSession
    path: str
    ranged: tuple[str, ...] = ()

    # -- the log --

    def _log(self) -> DataFrame:
        if not self._files(f"{self.path}/log"):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).json(f"{self.path}/log/*.json")

    def _hadoop(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self, folder: str) -> list[str]:
        target, system = self._hadoop(folder)
        return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []

    def version(self) -> int:
        """The newest version, -1 if there is none."""
        numbers = [int(n[:-5]) for n in self._files(f"{self.path}/log") if n.endswith(".json") and n[:-5].isdigit()]
        return max(numbers, default=-1)

    def history(self) -> DataFrame:
        """version, operation, files_added, rows_added, files_removed."""
        rows = F.aggregate("added", F.lit(0).cast("long"), lambda acc, a: acc + a["n"])
        return self._log().select("version", "operation", F.size("added").alias("files_added"), rows.alias("rows_added"), F.size("removed").alias("files_removed"))

    def files(self, version: int | None = None) -> DataFrame:
        """file, n, low, high of the files that make up a version, by default the newest."""
        last = self.version() if version is None else version
        if version is not None and not 0 <= version <= self.version():
            raise ValueError(f"no version {version}")
        log = self._log().where(F.col("version") <= last)
        gone = log.select(F.explode("removed").alias("file"))
        return log.select(F.inline("added")).join(gone, "file", "left_anti")

    # -- reading --

    def read(self, version: int | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
        """The rows of a version; ``between`` (column: (least, greatest), None for open) skips files by their ranges and rows by a filter.

        The names of the files kept reach the driver, as for any scan.
        """
        kept, rows = self.files(version), None
        for name, (least, greatest) in (between or {}).items():
            if name not in self.ranged:
                raise ValueError(f"no ranges are kept of {name}")
            kind = "double" if isinstance(least if least is not None else greatest, (int, float)) else "string"
            low, high = F.col("low")[name].cast(kind), F.col("high")[name].cast(kind)
            # A file of nulls alone has no range and no row in one.
            kept = kept.where((low <= F.lit(greatest)) if greatest is not None else low.isNotNull()).where((high >= F.lit(least)) if least is not None else high.isNotNull())
        names = sorted(r["file"] for r in kept.select("file").collect())
        if not names:
            every = self._log().select(F.inline("added")).select("file").first()
            if every is None:
                raise ValueError(f"no table at {self.path}")
            rows = self.spark.read.parquet(f"{self.path}/data/{every['file']}").limit(0)
        else:
            rows = self.spark.read.parquet(*(f"{self.path}/data/{n}" for n in names))
        for name, (least, greatest) in (between or {}).items():
            rows = rows.where(F.col(name) >= F.lit(least)) if least is not None else rows
            rows = rows.where(F.col(name) <= F.lit(greatest)) if greatest is not None else rows
        return rows

    # -- writing --

    def _written(self, rows: DataFrame) -> list[dict]:
        """Write data files and describe them; they belong to no version yet."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        if not any(n.endswith(".parquet") for n in self._files(f"{self.path}/data/{folder}")):
            return []
        stored = self.spark.read.parquet(f"{self.path}/data/{folder}")
        name = F.concat(F.lit(folder + "/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        ranges = [f(c).cast("string").alias(f"{k}_{i}") for i, c in enumerate(self.ranged) for k, f in (("low", F.min), ("high", F.max))]
        found = stored.groupBy(name.alias("file")).agg(F.count("*").alias("n"), *ranges).collect()
        return [{"file": r["file"], "n": r["n"], **{k: {c: r[f"{k}_{i}"] for i, c in enumerate(self.ranged) if r[f"{k}_{i}"] is not None} for k in ("low", "high")}} for r in found]

    def _commit(self, base: int, operation: str, added: list[dict], removed: list[str]) -> int:
        """Take the next free version after ``base``, unless a version in between removed a file that this one removes."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, system = self._hadoop(f"{self.path}/log/draft-{uuid.uuid4().hex}")
        number = base + 1
        for _ in range(ATTEMPTS):
            stream = system.create(draft, True)
            stream.write(bytearray(json.dumps({"version": number, "operation": operation, "added": added, "removed": removed}).encode()))
            stream.close()
            target = self._hadoop(f"{self.path}/log/{number:012d}.json")[0]
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else system.getUri(), conf)
            try:
                # Without the option to overwrite, moving onto an existing file fails.
                context.rename(draft, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
                return number
            except Exception as error:
                if not system.exists(target):
                    raise
                mine = set(removed)
                others = self._log().where((F.col("version") > base) & (F.col("version") <= self.version())).select(F.explode("removed").alias("file")).collect()
                if operation == "overwrite" or mine & {r["file"] for r in others}:
                    system.delete(draft, False)
                    raise ConcurrentChange(f"version {number} changed the files that were read at version {base}") from error
                number = self.version() + 1
        raise ConcurrentChange("no version number was free")

    def append(self, rows: DataFrame) -> int:
        """Add rows as a new version and return its number; other writers never disturb this."""
        return self._commit(self.version(), "append", self._written(rows), [])

    def overwrite(self, rows: DataFrame) -> int:
        """Replace all rows; ``rows`` may read this table.  Fails if a version came in between."""
        base = self.version()
        old = [r["file"] for r in self.files(base).select("file").collect()] if base >= 0 else []
        return self._commit(base, "overwrite", self._written(rows), old)

    def merge(self, incoming: DataFrame, key: str) -> int:
        """Put rows in the place of those with their key; only files that hold one of the keys are written anew.

        Rows without a key are added as they are.  Of incoming rows with one key the last by
        all other columns stays, whatever their order.  Fails if another writer changed one of those files.
        """
        base = self.version()
        rest = [F.col(c).desc_nulls_last() for c in incoming.columns if c != key]
        order = Window.partitionBy(key).orderBy(*(rest or [F.col(key)]))
        new = incoming.withColumn("_nth", F.row_number().over(order)).where((F.col("_nth") == 1) | F.col(key).isNull()).drop("_nth")
        new = materialize(new)
        if base < 0 or not self.files(base).limit(1).count():
            return self._commit(base, "merge", self._written(new), [])
        keys = new.select(key).where(F.col(key).isNotNull()).distinct()
        parts = F.split(F.col("_metadata.file_path"), "/")
        stored = self.read(base).withColumn("_file", F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)))
        touched = [r["_file"] for r in stored.join(keys, key, "left_semi").select("_file").distinct().collect()]
        if not touched:
            return self._commit(base, "merge", self._written(new), [])
        kept = self.spark.read.parquet(*(f"{self.path}/data/{n}" for n in touched)).join(keys, key, "left_anti")
        return self._commit(base, "merge", self._written(kept.select(*new.columns).unionByName(new)), touched)

    def delete_unused(self, keep: int) -> list[str]:
        """Remove the data of files that only versions before ``keep`` have; returns their names.

        Those versions can no longer be read; files of writes in progress are in no commit and
        stay.
        """
        live = self.files(keep).select("file")
        later = self._log().where(F.col("version") > keep).select(F.inline("added")).select("file")
        old = self._log().where(F.col("version") <= keep).select(F.inline("added")).select("file").join(live.union(later), "file", "left_anti")
        names = sorted(r["file"] for r in old.collect())
        for name in names:
            target, system = self._hadoop(f"{self.path}/data/{name}")
            system.delete(target, False)
        return names
