"""Tables that change by key: split into buckets by a hash, and changed together.

A table is a set of Parquet folders, one for each bucket and the version that wrote it. A manifest names, for all tables,
the version of each bucket. A change writes new folders for the buckets that it touches and reads no others; its manifest,
written last, makes all of it visible at once. Readers keep what they opened, and of a change that dies nothing is seen.

There is one writer at a time: two that begin from one version write the same manifest name, and the later one fails.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .work import save

BUCKETS = 64


def same_key(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of keys."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key isn't among keys; null keys are equal."""
    return rows.join(keys.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct(), same_key(on, [f"__{c}" for c in on]), "left_anti")


class Store:
    """The tables under a folder that all machines share; layout names each table's bucket columns."""

    def __init__(self, spark: SparkSession, path: str, layout: dict[str, list[str]], buckets: int = BUCKETS):
        self.spark, self.path, self.layout, self.buckets = spark, path.rstrip("/"), layout, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def manifest(self) -> dict:
        """version, tables (schema, buckets: bucket -> version), notes of the last change."""
        names = [n for n in self._names(f"{self.path}/manifest") if n.endswith(".json")]
        if not names:
            return {"version": 0, "tables": {}, "notes": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0])

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.layout[name]]), F.lit(self.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into: one number each, so no more than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect())

    def table(self, name: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """A table, or some of its buckets; None if it was never written."""
        own = (manifest or self.manifest())["tables"].get(name)
        if own is None:
            return None
        schema = StructType.fromJson(own["schema"])
        paths = [f"{self.path}/{name}/v={v}/bucket={k}" for k, v in own["buckets"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def near(self, name: str, rows: DataFrame, manifest: dict | None = None) -> DataFrame | None:
        """The buckets of a table that the keys of rows, which has the table's bucket columns, fall into."""
        return self.table(name, self.touched(name, rows), manifest)

    def begin(self) -> Change:
        return Change(self)

    def clean(self) -> int:
        """Deletes the folders that the last manifest doesn't name, and older manifests; how many. No reader may be at work on them."""
        now, gone = self.manifest(), []
        for name in self.layout:
            named = {f"v={v}/bucket={k}" for k, v in now["tables"].get(name, {"buckets": {}})["buckets"].items()}
            for v in self._names(f"{self.path}/{name}"):
                own = [x for x in self._names(f"{self.path}/{name}/{v}") if x.startswith("bucket=")]
                gone += [f"{self.path}/{name}/{v}/{x}" for x in own if f"{v}/{x}" not in named]
        gone += [f"{self.path}/manifest/{n}" for n in self._names(f"{self.path}/manifest")[:-1]]
        for path in gone:
            fs, p = self._fs(path)
            fs.delete(p, True)
        return len(gone)


class Change:
    """Changes of several tables that become visible together; reads through it see what it has written."""

    def __init__(self, store: Store):
        self.store, self.state = store, store.manifest()
        self.state["version"] += 1
        self.version, self.steps, self.written = self.state["version"], 0, {}

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        return self.store.table(name, buckets, self.state)

    def near(self, name: str, rows: DataFrame) -> DataFrame | None:
        return self.store.near(name, rows, self.state)

    def replace(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """rows become the whole content of the touched buckets; a bucket that gets none is empty."""
        own = self.state["tables"].setdefault(name, {"schema": json.loads(rows.schema.json()), "buckets": {}})
        self.steps += 1
        version = f"{self.version}-{self.steps}"
        path = f"{self.store.path}/{name}/v={version}"
        # Rows of a bucket go together, but a bucket with most of them is split.
        kept = rows.select(*StructType.fromJson(own["schema"]).fieldNames())
        kept.withColumn("bucket", self.store.bucket(name)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        there = {int(n.split("=")[1]) for n in self.store._names(path) if n.startswith("bucket=")}
        if there - set(touched):
            raise ValueError(f"{name}: rows outside the buckets that change")
        for k in touched:
            own["buckets"].pop(str(k), None)
        own["buckets"].update({str(k): version for k in there})
        self.written.setdefault(name, set()).update(touched)

    def upsert(self, name: str, rows: DataFrame, key: list[str], first: list[Column] | None = None) -> None:
        """rows take the place of stored ones with their key, which holds the bucket columns.

        With first, of all rows of a key, old and new, the first by that order stays. Without it keys of rows are unique.
        """
        rows = save(rows, f"new-{name}")
        touched = self.store.touched(name, rows)
        old = self.table(name, touched)
        if old is None:
            both = rows
        else:
            both = (old if first else without(old, rows, key)).unionByName(rows)
        if first:
            both = both.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*first))).filter("__nth = 1").drop("__nth")
        self.replace(name, both, touched)

    def delete(self, name: str, keys: DataFrame, on: list[str] | None = None, touched: list[int] | None = None) -> None:
        """Rows whose columns on (the bucket columns, if not given) are among keys go; touched tells their buckets, where keys can't."""
        on = on or self.store.layout[name]
        keys = save(keys.select(*on).distinct(), f"gone-{name}")
        touched = self.store.touched(name, keys) if touched is None else touched
        old = self.table(name, touched)
        if old is not None and touched:
            self.replace(name, without(old, keys, on), touched)

    def patch(self, name: str, keys: DataFrame, changes: dict[str, Column]) -> None:
        """changes in the rows whose bucket columns are among keys."""
        on = self.store.layout[name]
        keys = save(keys.select(*on).distinct(), f"patched-{name}")
        touched = self.store.touched(name, keys)
        old = self.table(name, touched)
        if old is not None:
            marked = old.join(keys.select(*[F.col(c).alias(f"__{c}") for c in on], F.lit(True).alias("__hit")), same_key(on, [f"__{c}" for c in on]), "left")
            self.replace(name, marked.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in changes.items()}), touched)

    def commit(self, **notes) -> int:
        """Make the change visible; its version."""
        self.state["notes"] = self.state["notes"] | notes
        fs, final = self.store._fs(f"{self.store.path}/manifest/{self.version:012d}.json")
        if fs.exists(final):
            raise RuntimeError(f"version {self.version} was written by another change")
        _, part = self.store._fs(f"{self.store.path}/manifest/.{self.version:012d}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if not fs.rename(part, final):
            raise RuntimeError(f"version {self.version} was written by another change")
        return self.version
