"""Curation kept up to date: new measurements change only what they touch.

What curation needs to know of all rows so far is their (key, value, count, first row) table, dealt to buckets by key. A batch is
counted the same way and merged into the buckets that hold its keys; those are written anew beside the old ones, with their curated
rows, and a manifest then names the present version of every bucket. The manifest's name has the batch's number, so a batch that broke
off before changes nothing, and one that is applied again is recognised. Other buckets are not read.

A group keeps the split that it had when it was first seen, so rows never change sides; new groups are dealt by the usual rule, into
the room that the shares leave.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.numeric import negative_log_molar
from assayloom.operators.collapse import collapse_counts, value_counts
from assayloom.operators.split import SHARES, SPLITS, assign_groups
from assayloom.staging import stage

BUCKETS = 256


@dataclass
class Curated:
    """A curated table at a path. ``group`` is one of ``first`` and equal for all rows of a key, or the key itself."""

    spark: SparkSession
    path: str
    key: str
    value: str
    first: Sequence[str]
    order: Sequence[str]
    group: str
    buckets: int = BUCKETS
    shares: Sequence[int] = SHARES

    def _manifests(self) -> list[dict]:
        try:
            rows = self.spark.read.text(f"{self.path}/manifests/*").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["batch"])

    def versions(self) -> dict[int, str]:
        """The present folder of each bucket that has rows."""
        found: dict[int, str] = {}
        for manifest in self._manifests():
            found |= {int(b): manifest["run"] for b in manifest["buckets"]}
        return found

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        present = self.versions()
        chosen = sorted(present if buckets is None else set(buckets) & set(present))
        if not chosen:
            return None
        paths = [f"{self.path}/{kind}/run={present[b]}/bucket={b}" for b in chosen]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*paths).drop("run", "bucket")

    def rows(self) -> DataFrame | None:
        """``key, n, median, first ..., y`` of every key so far; None before the first batch."""
        return self._read("curated")

    def groups(self) -> DataFrame | None:
        """``group, split`` of every group so far."""
        runs = [m["run"] for m in self._manifests() if m["buckets"]]
        return self.spark.read.parquet(*[f"{self.path}/groups/run={r}" for r in runs]) if runs else None

    def split_rows(self) -> DataFrame:
        """The curated rows with the split of their group."""
        named = self.key if self.group == self.key else f"first_{self.group}"
        known = self.groups().withColumnRenamed("group", "_group")
        joined = self.rows().join(known, F.col(named).eqNullSafe(F.col("_group")))
        return joined.drop("_group")

    def add(self, batch: DataFrame, number: int) -> bool:
        """Merge a batch of cleaned rows; False if a batch of that number is there already. Batches come one at a time."""
        done = self._manifests()
        if any(m["batch"] == number for m in done):
            return False
        run = uuid.uuid4().hex
        new = stage(value_counts(batch, [self.key], self.value, self.first, self.order), "batch-counts")
        touched = [r["bucket"] for r in new.select(self._bucket().alias("bucket")).distinct().collect()]
        if touched:
            self._merge(new, touched, run)
        manifest = json.dumps({"batch": number, "run": run, "buckets": sorted(touched)})
        line = self.spark.createDataFrame([(manifest,)], "value string").coalesce(1)
        line.write.mode("overwrite").text(f"{self.path}/manifests/batch={number}")
        return True

    def _merge(self, new: DataFrame, touched: list[int], run: str) -> None:
        old = self._read("counts", touched)
        merged = new if old is None else new.unionByName(old).groupBy(self.key, "_value").agg(
            F.sum("_weight").alias("_weight"), F.min("_first").alias("_first")
        )
        counts = self._written(merged, "counts", run)
        collapsed = collapse_counts(counts, [self.key], self.value, self.first)
        curated = self._written(collapsed.withColumn("y", negative_log_molar(F.col(f"median_{self.value}"))), "curated", run)
        self._add_groups(curated, run)

    def _written(self, df: DataFrame, kind: str, run: str) -> DataFrame:
        path = f"{self.path}/{kind}/run={run}"
        df.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(path)
        return self.spark.read.schema(df.schema).parquet(f"{path}/bucket=*")

    def _add_groups(self, curated: DataFrame, run: str) -> None:
        named = self.key if self.group == self.key else f"first_{self.group}"
        sizes = curated.groupBy(F.col(named).alias("group")).agg(F.count(F.lit(1)).alias("size"), F.min(self.key).alias("first_row"))
        known, held = self.groups(), (0, 0, 0)
        if known is not None:
            renamed = known.withColumnRenamed("group", "_known")
            sizes = sizes.join(renamed, F.col("group").eqNullSafe(F.col("_known")), "left_anti")
            counted = self.split_rows().groupBy("split").count().collect()
            held = tuple({r["split"]: r["count"] for r in counted}.get(s, 0) for s in SPLITS)
        sizes = stage(sizes, "new-groups")
        histogram = [(r["size"], r["count"]) for r in sizes.groupBy("size").count().collect()]
        assigned = assign_groups(sizes, "group", histogram, self.shares, held)
        assigned.select("group", "split").write.parquet(f"{self.path}/groups/run={run}")
