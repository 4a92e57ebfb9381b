"""Keyed tables as Parquet parts behind a log of commits.

A commit is one small file that names the live parts of every bucket; rows belong to the bucket
of their key's hash. A merge reads the keys of the buckets it touches, rewrites the parts in
which one of its keys stands, and adds one part to each touched bucket. Other parts, and all
other buckets, stay as they are: the work follows the change, not the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stage

BUCKET = "_bucket"
#: Parts of a bucket from which on a merge into it writes them as one.
MOST_PARTS = 8


class Conflict(RuntimeError):
    """Another writer's commit came first; read again and retry."""


class KeyedTable:
    """A table with a unique key below ``root``.

    Readers see the last whole commit. A failed or lost job leaves parts that no commit names.
    Commits are numbered, and a number can be taken only once, so of two writers one gets a
    ``Conflict``. The number of buckets is fixed by the first commit.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(keys), buckets

    # --- the log ---

    def _fs(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def commits(self) -> list[int]:
        fs, log = self._fs(f"{self.root}/log")
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, number: int | None = None) -> dict:
        """``buckets``: their number; ``parts``: live parts by bucket; ``epochs``: last one of each stream; ``schema``."""
        known = self.commits()
        if number is None and not known:
            return {"buckets": self.buckets, "parts": {}, "epochs": {}, "schema": None}
        text = self.spark.read.text(f"{self.root}/log/{known[-1] if number is None else number:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, number: int, manifest: dict) -> None:
        fs, draft = self._fs(scratch_path(self.spark, "commit") + ".json")
        _, final = self._fs(f"{self.root}/log/{number:012d}.json")
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise Conflict(f"commit {number} of {self.root} exists")

    # --- reading ---

    def _read(self, manifest: dict, parts: dict[str, list[str]]) -> DataFrame | None:
        paths = [f"{self.root}/data/{part}/{BUCKET}={bucket}" for bucket, names in parts.items() for part in names]
        if not paths:
            return None
        schema = self.spark.createDataFrame([], manifest["schema"]).schema
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, number: int | None = None) -> DataFrame | None:
        """The table as of a commit, the last one by default; None before the first."""
        manifest = self.manifest(number)
        return self._read(manifest, manifest["parts"])

    # --- writing ---

    def merge(self, new: DataFrame, newest: str | None = None, stream: str | None = None, epoch: int | None = None) -> bool:
        """Insert rows, and replace those with the same key; of rows of one key in ``new`` the one with the
        largest ``newest`` is taken (without it they must be unique).

        With ``stream`` and ``epoch`` the merge is part of a stream's batch, and a batch that the
        table has already is left out: False comes back.
        """
        manifest, number = self.manifest(), (self.commits() or [-1])[-1] + 1
        if stream is not None and manifest["epochs"].get(stream, -1) >= epoch:
            return False
        columns = new.columns
        if newest:
            rest = [c for c in columns if c not in self.keys]
            new = new.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), newest).alias("_r")).select(*self.keys, "_r.*").select(*columns)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(manifest["buckets"])).cast("int")
        new = stage(new.withColumn(BUCKET, bucket), "merge")
        touched = [str(r[0]) for r in new.select(BUCKET).distinct().collect()]
        live = {b: manifest["parts"].get(b, []) for b in touched}
        old = self._read(manifest, live)
        parts = dict(manifest["parts"])
        rows = new
        if old is not None:
            # where each row stands, from its file's name: .../data/<part>/_bucket=<bucket>/<file>
            place = F.regexp_extract(F.col("_metadata.file_path"), rf"data/([^/]+)/{BUCKET}=(\d+)/[^/]+$", 0)
            part, its = (F.regexp_extract(place, rf"data/([^/]+)/{BUCKET}=(\d+)/", i) for i in (1, 2))
            old = old.select("*", part.alias("_part"), its.alias("_its"))
            hit = old.select(*self.keys, "_part", "_its").join(new.select(*self.keys), self.keys, "left_semi").select("_part", "_its").distinct().collect()
            again = {(r["_its"], r["_part"]) for r in hit} | {(b, p) for b, names in live.items() if len(names) >= MOST_PARTS for p in names}
            gone = {b: [p for p in live[b] if (b, p) in again] for b in touched}
            rewritten = self._read(manifest, {b: names for b, names in gone.items() if names})
            if rewritten is not None:
                rows = rewritten.join(new.select(*self.keys), self.keys, "left_anti").withColumn(BUCKET, bucket).unionByName(new)
            live = {b: [p for p in live[b] if (b, p) not in again] for b in touched}
        name = f"c{number:012d}-{uuid.uuid4().hex[:8]}"  # a writer that loses leaves its part unnamed
        if touched:
            # a bucket may be written by several tasks: adaptive execution splits and joins them by size
            rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{name}")
        parts |= {b: [*live[b], name] for b in touched}
        epochs = manifest["epochs"] | ({stream: epoch} if stream is not None else {})
        schema = manifest["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.drop(BUCKET).schema.fields)
        self._commit(number, {"buckets": manifest["buckets"], "parts": parts, "epochs": epochs, "schema": schema})
        return True


def scratch_keyed(spark: SparkSession, name: str, keys: Sequence[str], buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, scratch_path(spark, name), keys, buckets)


class OpsSink:
    """Operations with the ids of their aircraft; tails that the aircraft table lacks are added to it.

    Both tables are keyed, so a batch that is delivered again changes nothing.
    """

    def __init__(self, ops: KeyedTable, aircraft: KeyedTable):
        self.ops, self.aircraft = ops, aircraft

    def add(self, operations: DataFrame, stream: str | None = None, epoch: int | None = None) -> None:
        """``operations``: tail, now, operation and further columns."""
        from ..operators.tables_ops import lookup_or_insert

        rows = stage(operations, "operations")
        known = self.aircraft.read()
        if known is None:
            known = rows.select("tail", F.lit("").alias("aircraft_id")).where("false")
        named, missing = lookup_or_insert(rows, known)
        if not missing.isEmpty():
            self.aircraft.merge(missing.select("tail", "aircraft_id"))  # before the operations that refer to them
        self.ops.merge(named, newest="aircraft_id", stream=stream, epoch=epoch)
