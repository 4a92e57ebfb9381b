"""URL filters as a sort-merge range join.

A host turns into its labels in reverse order, each ended by a dot, so a rule for a host
covers the interval of keys that begin with the rule's key, and intervals nest. URLs and
rules are dealt by sampled splitters of the key, sorted, and swept in order with a stack of
the rules that are still open. A rule goes to every range its interval touches: those it
spans whole are few, as only the ancestors of a splitter do.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, partitions

#: Rows of a range, about, and sampled keys per range.  Beyond ``MOST_RANGES`` ranges each gets
#: longer instead, so the driver samples some 400,000 keys at most and broadcasts 20,000 of them.
RANGE_ROWS = 200_000
SAMPLES = 20
MOST_RANGES = 20_000
LEAST_ID = -(1 << 63)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    at = F.locate("://", url)
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``; an empty host is an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Open rules are a stack of (key, {path: (rule, verdict)}, path lengths)."""
    stack: list[tuple[str, dict, list[int]]] = []
    for batch in batches:
        keys, paths, hosts, verdicts, ids = (batch.column(i).to_pylist() for i in range(5))
        at, rules, found = [], [], []
        for i, (key, path, verdict) in enumerate(zip(keys, paths, verdicts)):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if verdict is not None:  # a rule opens
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                known = stack[-1][1]
                if path not in known:
                    bisect.insort(stack[-1][2], len(path))
                if path not in known or verdict == "block":
                    known[path] = (hosts[i] + path, verdict)
                continue
            best, length = (None, default), -1
            for own, known, lengths in stack:
                for n in reversed(lengths):
                    if n <= len(path) and (hit := known.get(path[:n])):
                        if len(hit[0]) >= length:
                            best, length = hit, len(hit[0])
                        break
            at.append(i)
            rules.append(best[0])
            found.append(best[1])
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(4).take(take), batch.column(2).take(take), batch.column(1).take(take), pa.array(rules, pa.string()), pa.array(found, pa.string())],
            names=["_id", "_host", "_path", "_rule", "_verdict"])


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge URLs by rules ``host, path, action`` (``allow`` or ``block``).

    Returns one row per input row: ``id, host, path, rule, verdict``.

    * A rule fits its host and all subdomains if the URL's path starts with the rule's path;
      the rule whose host and path together are longest wins. Of equal rules, ``block`` wins.
      An empty rule host fits every URL.
    * URLs that no rule fits get ``default`` and a null rule; null URLs and URLs without
      ``://`` have an empty host and path.
    * Rules of equal total length that fit one URL: the one with the longer host wins.
    * Rules with a null field are left out. Null ids and repeated rows are judged like others.
    * An empty table on either side works. Other columns are not read.

    ``id`` is an integer column: it splits a host, or a URL, that owns many rows.
    """
    spark, wide = pages.sparkSession, F.col("_id").cast("long")
    url = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("_host"), path_of(url).alias("_path"))
    urls = urls.select("_id", "_host", "_path", reversed_host(F.col("_host")).alias("_key"))
    given = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isin("allow", "block")).select(
        ascii_lower(F.col("host")).alias("_host"), F.col("path").alias("_path"), F.col("action").alias("_verdict"))
    given = given.withColumn("_key", reversed_host(F.col("_host")))

    n = urls.count()
    parts = min(max(partitions(spark), -(-n // RANGE_ROWS)), MOST_RANGES)
    # As many keys as SAMPLES times the ranges, about, whatever the size of the table.
    share = min(1.0, SAMPLES * parts / max(n, 1))
    sample = sorted((r[0], r[1], r[2]) for r in urls.select("_key", "_path", F.coalesce(wide, F.lit(LEAST_ID))).sample(share, seed=7).collect())
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    heads = [c[0] for c in cuts]
    held = spark.sparkContext.broadcast(cuts)

    def ranges(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for key, path, doc in batches:
            rows = zip(key.to_pylist(), path.to_pylist(), doc.to_pylist())
            yield pa.array([bisect.bisect_right(held.value, r) for r in rows], pa.int32())

    def touched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for key in batches:
            yield pa.array([list(range(bisect.bisect_left(heads, k), bisect.bisect_right(heads, k + "\U0010ffff") + 1)) for k in key.to_pylist()], pa.list_(pa.int32()))

    none = F.lit(None).cast(pages.schema[id_col].dataType)
    a = urls.withColumn("_part", F.arrow_udf(ranges, "int")("_key", "_path", F.coalesce(wide, F.lit(LEAST_ID)))).withColumn("_verdict", F.lit(None).cast("string"))
    b = given.withColumn("_part", F.explode(F.arrow_udf(touched, "array<int>")("_key"))).withColumn("_id", none)
    both = a.select("_key", "_path", "_host", "_verdict", "_id", "_part").unionByName(b.select("_key", "_path", "_host", "_verdict", "_id", "_part"))
    both = both.repartitionById(parts, F.col("_part")).sortWithinPartitions("_key", F.col("_verdict").isNull(), "_path", "_id").drop("_part")
    kind = pages.schema[id_col].dataType.simpleString()
    out = both.mapInArrow(lambda it: _sweep(it, default), f"_id {kind}, _host string, _path string, _rule string, _verdict string")
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
