"""Tables as versioned Parquet folders with a pointer, since plain Parquet has no update: keyed merges add parts."""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableStore:
    """One writer at a time for a table. A version is complete before the pointer names it, and the pointer is moved into
    its place, so readers never see half of one. Merges add a part that is folded in when the table is read; after
    FOLD parts the table is written anew."""

    FOLD = 8

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        uri = self.root if "://" in self.root else f"file://{self.root}"
        self.files, self.base = fs.FileSystem.from_uri(uri)

    def _pointer(self, name: str) -> str:
        return f"{self.base}/{name}/CURRENT"

    def _load(self, path: str) -> dict:
        with self.files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _exists(self, path: str) -> bool:
        return self.files.get_file_info(path).type != fs.FileType.NotFound

    def _current(self, name: str) -> dict | None:
        return self._load(self._pointer(name)) if self._exists(self._pointer(name)) else None

    def version(self, name: str) -> str | None:
        current = self._current(name)
        return None if current is None else current["version"]

    def read(self, name: str) -> DataFrame | None:
        current = self._current(name)
        if current is None:
            return None
        df = self.spark.read.parquet(f"{self.root}/{name}/{current['version']}")
        for part in current.get("parts", []):
            df = merge_keyed(df, self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}/{part['path']}"), part["keys"], part["rule"])
        return df

    def _point(self, name: str, current: dict) -> None:
        beside = f"{self._pointer(name)}-{uuid.uuid4().hex}"
        with self.files.open_output_stream(beside) as f:
            f.write(json.dumps(current).encode())
        self.files.move(beside, self._pointer(name))

    def write(self, name: str, df: DataFrame) -> str:
        v = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{v}")
        self._point(name, {"version": v})
        return v

    def part(self, name: str, key: str) -> str:
        return f"{self.root}/{name}/{key}"

    def write_once(self, name: str, key: str, df: DataFrame) -> bool:
        """An immutable part named by its content key: written only if it isn't there yet."""
        if self._exists(f"{self.base}/{name}/{key}/_SUCCESS"):
            return False
        df.write.mode("overwrite").parquet(self.part(name, key))
        return True

    def merge(self, name: str, updates: DataFrame, keys: list[str], rule: str = "replace") -> str:
        """Take updates in by keys. Repeated keys in the updates raise: which of them should win is the caller's to say."""
        current = self._current(name)
        if current is None:
            return self.write(name, updates)
        path = f"p-{uuid.uuid4().hex}"
        updates.write.parquet(f"{self.root}/{name}/{path}")
        stored = self.spark.read.parquet(f"{self.root}/{name}/{path}")
        twice = stored.groupBy(*keys).count().where("count > 1").select(*keys).first()
        if twice is not None:
            raise ValueError(f"{name}: several updates of {tuple(twice)}")
        parts = [*current.get("parts", []), {"path": path, "keys": keys, "rule": rule}]
        self._point(name, {"version": current["version"], "parts": parts})
        return self.write(name, self.read(name)) if len(parts) >= self.FOLD else path

    def names(self, folder: str) -> list[str]:
        if not self._exists(f"{self.base}/{folder}"):
            return []
        return sorted(i.base_name for i in self.files.get_file_info(fs.FileSelector(f"{self.base}/{folder}")) if i.type == fs.FileType.Directory)

    def small_files(self, folder: str) -> dict[str, dict]:
        """The small files of a folder by name."""
        if not self._exists(f"{self.base}/{folder}"):
            return {}
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/{folder}"))
        return {i.base_name: self._load(i.path) for i in found if i.type == fs.FileType.File and i.base_name.startswith(("claim-", "end-"))}

    def create_small(self, path: str, content: dict) -> bool:
        """Create a small file, whole, unless it is there: of several that try, one succeeds. False for the others.

        The content is written beside it and linked or renamed without replacing, by Hadoop's file system, or by the
        operating system for a local folder.
        """
        target = f"{self.base}/{path}"
        self.files.create_dir(target.rsplit("/", 1)[0], recursive=True)
        data = json.dumps(content).encode()
        beside = f"{target.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(beside) as f:
            f.write(data)
        if isinstance(self.files, fs.LocalFileSystem):
            try:
                os.link(beside, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(beside)
        jvm, scheme = self.spark._jvm, self.root.split("://")[0] + "://" if "://" in self.root else ""
        place = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p.removeprefix(self.base + '/')}" if scheme else p)
        hadoop = place(target).getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = bool(hadoop.rename(place(beside), place(target)))
        if not done:
            self.files.delete_file(beside)
        return done


def merge_keyed(current: DataFrame, updates: DataFrame, keys: list[str], rule: str = "replace") -> DataFrame:
    """Full outer join on the keys, nulls being equal. rule `replace`: an update's values win; `keep`: the row that is there
    wins; `fill`: nulls are filled. Keys are distinct in the updates."""
    rest = [c for c in current.columns if c not in keys]
    held = lambda df, side: df.select(*[F.struct(F.col(k)).alias(f"_{side}_{k}") for k in keys], F.struct(*rest, F.lit(1).alias("_is")).alias(f"_{side}"))
    both = held(current, "old").join(held(updates, "new"), reduce(lambda x, y: x & y, [F.col(f"_old_{k}.{k}").eqNullSafe(F.col(f"_new_{k}.{k}")) for k in keys]), "full_outer")
    both = both.withColumns({k: F.when(F.col("_old").isNotNull(), F.col(f"_old_{k}.{k}")).otherwise(F.col(f"_new_{k}.{k}")) for k in keys})
    pick = {
        "replace": lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")),
        "keep": lambda c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")),
        "fill": lambda c: F.coalesce(f"_old.{c}", f"_new.{c}"),
    }[rule]
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break a rule, with the rule's name."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(e), F.lit(False)), F.lit(n)) for n, e in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def reconcile(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: counts of both, keys that are lost, added, or there several times. A migration is good if lost and repeated are 0."""
    a = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    b = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    j = a.join(b, keys, "full_outer")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return j.agg(n("_b").alias("before"), n("_a").alias("after"), F.count_if(F.col("_a").isNull()).alias("lost"), F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(F.col("_a") > 1).alias("repeated"))
