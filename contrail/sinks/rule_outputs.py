"""Outputs of rule actions: emitted records, operations, upserts, provenance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables_ops import upsert
from ..session import scratch_path, task_count


def emit_jsonl(rules, fired: DataFrame, path: str, mode: str = "append") -> None:
    """Write the raw record of every firing of an ``emit_jsonl`` rule below
    ``path/rule=<name>`` as gzipped lines; a report may go to several rules.

    Rows are spread by rule and record, so one busy rule is written by many tasks.
    """
    names = [n for n, b in rules.rules.items() if "emit_jsonl" in (b["actions"] or {})]
    rows = fired.where(F.col("rule").isin(names)).select("rule", F.col("raw").alias("value"))
    n = task_count(fired)
    rows.repartition(n, "rule", F.pmod(F.xxhash64("value"), F.lit(n))).write.mode(mode).partitionBy("rule").option("compression", "gzip").text(path)


def operations(noted: DataFrame, takeoffs: Sequence[str], landings: Sequence[str]) -> DataFrame:
    """Takeoffs and landings; a landing is local when a note was set in the same life."""
    kind = F.when(F.col("rule").isin(list(takeoffs)), "Takeoff").when(F.col("rule").isin(list(landings)), "Landing")
    rows = noted.withColumn("operation", kind).where(F.col("operation").isNotNull())
    local = (F.col("operation") == "Landing") & F.col("note").isNotNull()
    return rows.select("tail", "now", "operation", local.alias("is_local"))


class TableSink:
    """A small Parquet table kept in versions below a root folder; for large ones see ``commit_log.KeyedTable``.

    Each write adds a complete version and then points to it, so readers never see
    half a write and a failed job leaves the previous version in place.
    """

    def __init__(self, spark, root: str, partition: str | None = None):
        self.spark, self.root, self.partition = spark, root.rstrip("/"), partition

    def _versions(self) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(p.getName() for p in done)

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.root}/{versions[-1]}") if versions else None

    def write(self, df: DataFrame) -> None:
        versions = self._versions()
        nxt = int(versions[-1][1:]) + 1 if versions else 0
        writer = df.write.mode("overwrite")
        if self.partition:
            writer = writer.partitionBy(self.partition)
        writer.parquet(f"{self.root}/v{nxt:08d}")

    def append(self, df: DataFrame) -> None:
        old = self.read()
        self.write(df if old is None else old.unionByName(df))

    def append_epoch(self, df: DataFrame, epoch: int) -> None:
        """Append of a streaming batch: a replayed epoch replaces its own rows."""
        df.write.mode("overwrite").parquet(f"{self.root}/epochs/epoch={epoch}")

    def read_epochs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/epochs")

    def merge(self, new: DataFrame, keys: Sequence[str], newest: str | None = None) -> None:
        """Insert or replace by key; within ``new`` the row with the largest ``newest`` wins."""
        if newest:
            rest = [c for c in new.columns if c not in keys]
            new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_r")).select(*keys, "_r.*").select(*new.columns)
        old = self.read()
        self.write(new if old is None else upsert(old, new, keys))


def batch_handler(handler: Callable[[DataFrame], None], required: bool = False) -> Callable[[DataFrame, int], None]:
    """Adapter for ``foreachBatch``. A failing alert is reported and the stream goes on; a handler that is
    ``required``, as one that writes a table, fails the batch, which Spark then delivers again."""
    def run(df: DataFrame, epoch: int) -> None:
        try:
            handler(df)
        except Exception as error:
            if required:
                raise
            print(f"handler failed in batch {epoch}: {error}")

    return run


def scratch_table(spark, name: str, partition: str | None = None) -> TableSink:
    return TableSink(spark, scratch_path(spark, name), partition)
