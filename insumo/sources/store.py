"""Versioned snapshots of tables with compare-and-set revisions, backups, retention and an audit log (a local or mounted folder)."""

from __future__ import annotations

import json
import os
import shutil
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables under `root`: each revision is a folder of Parquet tables, published by creating one small file that must not exist."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        (self.root / "versions").mkdir(parents=True, exist_ok=True)

    def revision(self) -> int:
        return max((int(p.stem) for p in (self.root / "versions").glob("*.json")), default=0)

    def save(self, tables: dict[str, DataFrame], expected: int | None, label: str = "save") -> dict:
        """Writes the next revision. A client behind the present one gets a conflict as a result, not an exception; of two
        that write at once the second gets one. Tables that aren't given are taken over from the present revision."""
        current = self.revision()
        if expected is not None and expected < current:
            return {"ok": False, "conflict": True, "current_revision": current, "client_revision": expected}
        new = current + 1
        paths = dict(self._entry(current)["tables"]) if current else {}
        for name, df in tables.items():
            path = str(self.root / "data" / f"{new}-{os.getpid()}-{time.time_ns()}" / name)
            df.write.parquet(path)
            paths[name] = path
        try:
            with open(self.root / "versions" / f"{new}.json", "x") as f:
                json.dump({"revision": new, "label": label, "at": time.time(), "tables": paths}, f)
        except FileExistsError:
            return {"ok": False, "conflict": True, "current_revision": self.revision(), "client_revision": expected}
        return {"ok": True, "conflict": False, "current_revision": new, "client_revision": expected}

    def _entry(self, revision: int) -> dict:
        return json.loads((self.root / "versions" / f"{revision}.json").read_text())

    def load(self, name: str, revision: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._entry(revision or self.revision())["tables"][name])

    def versions(self) -> DataFrame:
        """revision, label, at of what is kept, the newest first."""
        rows = [self._entry(int(p.stem)) for p in (self.root / "versions").glob("*.json")]
        return self.spark.createDataFrame([(r["revision"], r["label"], r["at"]) for r in rows], "revision int, label string, at double").orderBy(F.col("revision").desc())

    def restore(self, revision: int) -> dict:
        """The tables of an old revision as the newest one."""
        old = self._entry(revision)["tables"]
        return self.save({n: self.spark.read.parquet(p) for n, p in old.items()}, None, f"restore {revision}")

    def retain(self, n: int = 60) -> int:
        """Keeps the newest n revisions; returns how many were removed. Folders that a kept revision still uses stay."""
        every = sorted((int(p.stem) for p in (self.root / "versions").glob("*.json")), reverse=True)
        used = {p for r in every[:n] for p in self._entry(r)["tables"].values()}
        for r in every[n:]:
            for p in self._entry(r)["tables"].values():
                if p not in used:
                    shutil.rmtree(p, ignore_errors=True)
            (self.root / "versions" / f"{r}.json").unlink()
        return len(every[n:])


def replaced(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Keyed replacement: the changes, and the rows of other keys."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def added(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-ignore: rows whose key is new."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"), allowMissingColumns=True)


def without(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The table without the rows of these keys (undo of a batch)."""
    return table.join(keys.select(*key), key, "left_anti")


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Audit log of two states: key, field, before, after of fields that differ; added and removed rows have null on one side."""
    a = before.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    b = after.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("before"), F.col(f"a_{f}").alias("after")) for f in fields))
    return a.join(b, key, "full").select(key, F.explode(each).alias("c")).select(key, "c.*").filter(~F.col("before").eqNullSafe(F.col("after")))


def archived(products: DataFrame, ids: DataFrame, flag: bool = True) -> DataFrame:
    """Soft deletion, or its undoing, of the products in ids."""
    m = ids.select(F.col("id"), F.lit(True).alias("_m")).distinct()
    return products.join(m, "id", "left").withColumn("archived", F.when(F.col("_m"), flag).otherwise(F.col("archived"))).drop("_m")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
