"""Fill-in-the-middle examples from whole texts, with cuts found through remembered chunks.

A rolling hash of the last 32 bytes chunks a text where the hash says so, so passages that texts
share come out as the same chunks wherever they stand. A chunk's summary says how many units
begin in it, given what stands before it; it is looked up by the chunk's whole content, so chunks
of equal hash can't be mistaken. Summaries combine from left to right into the text's number of
units, and the running counts say in which chunk a cut lies: only that chunk is read again.

Texts go to Python for three numbers; the parts are put together, and taken apart again, by
functions of Columns.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("chars", "words")
#: Bytes of a chunk: at least, about (a power of two), at most.
LEAST, ABOUT, MOST = 256, 1024, 8192
#: Bytes that the rolling hash covers, and bytes hashed at once.
WINDOW, SEGMENT = 32, 1 << 20
#: Bytes of chunks that a task remembers.
REMEMBER = 32 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 32, 256, np.uint32)
CUTS = "struct<n:bigint,first:bigint,second:bigint,begin:bigint,end:bigint>"


def borders(data: np.ndarray) -> np.ndarray:
    """Places where the hash of the ``WINDOW`` bytes up to there, they included, asks for a cut behind them."""
    found = []
    for at in range(0, max(1, len(data)), SEGMENT):
        lead = min(at, WINDOW - 1)
        h, reach = _MIX[data[at - lead:at + SEGMENT]], 1
        while reach < WINDOW:  # the sum of 2k bytes from two sums of k
            nxt = h.copy()
            nxt[reach:] += h[:-reach] << np.uint32(reach)
            h, reach = nxt, 2 * reach
        found.append(np.flatnonzero(h[lead:] < np.uint32((1 << 32) // ABOUT)) + at)
    return np.concatenate(found)


def chunks(data: np.ndarray, cuts: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The chunks of ``data[start:end]``, which depend on these bytes alone."""
    while start < end:
        stop = min(start + MOST, end)
        k = int(np.searchsorted(cuts, start + LEAST - 1))
        if k < len(cuts) and cuts[k] + 1 < stop:
            stop = int(cuts[k]) + 1
        yield start, stop
        start = stop


def begins(data: np.ndarray, units: str, apart: bool) -> np.ndarray:
    """Which bytes begin a unit. ``apart``: a word would begin with the first byte."""
    if units == "chars":
        return (data & 0xC0) != 0x80
    gap = _SPACE[data]
    before = np.empty(len(gap), bool)
    before[0], before[1:] = apart, gap[:-1]
    return before & ~gap


class Memory:
    """Summaries of chunks by their content; the least recently used go first."""

    def __init__(self, units: str, size: int = REMEMBER):
        self.units, self.size, self.held, self.known = units, size, 0, OrderedDict()

    def summary(self, data: np.ndarray) -> tuple[int, int, bool]:
        """Units that begin in the chunk after a gap, and inside a unit; whether the chunk ends with a gap."""
        key = data.tobytes()
        found = self.known.get(key)
        if found is None:
            here = begins(data, self.units, True)
            total = int(np.count_nonzero(here))
            found = (total, total - int(self.units == "words" and here[0]), self.units == "words" and bool(_SPACE[data[-1]]))
            self.known[key] = found
            self.held += len(key)
            while self.held > self.size and len(self.known) > 1:
                self.held -= len(self.known.popitem(last=False)[0])
        else:
            self.known.move_to_end(key)
        return found

    def counted(self, data: np.ndarray, cuts: np.ndarray, start: int, end: int) -> tuple[list[tuple[int, int, int, bool]], int]:
        """Chunks as (start, end, units before it, whether it follows a gap), and the number of units in all."""
        out, total, apart = [], 0, True
        for a, b in chunks(data, cuts, start, end):
            out.append((a, b, total, apart))
            fresh, inside, gap = self.summary(data[a:b])
            total, apart = total + (fresh if apart else inside), gap
        return out, total

    def place(self, data: np.ndarray, parts: list[tuple[int, int, int, bool]], k: int, total: int, end: int) -> int:
        """Where the text goes on after its first ``k`` units: at its beginning, at a unit's, or at its end."""
        if k <= 0 or k >= total:
            return parts[0][0] if k <= 0 and parts else end
        lo, hi = 0, len(parts) - 1
        while lo < hi:  # the last chunk with at most k units before it that are not after the cut
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if parts[mid][2] <= k else (lo, mid - 1)
        a, b, before, apart = parts[lo]
        return a + int(np.flatnonzero(begins(data[a:b], self.units, apart))[k - before])


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings and where each begins, without a copy of the bytes; null is empty."""
    wide = texts.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + len(wide) + 1] if offsets is not None and len(wide) else np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def _locate(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]], units: str) -> Iterator[pa.Array]:
    memory = Memory(units)
    for texts, one, two in batches:
        data, ends = _flat(texts)
        picks = np.stack([x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (one, two)]) if len(texts) else np.zeros((2, 0), np.int64)
        out = np.zeros((5, len(texts)), np.int64)
        row = 0
        while row < len(texts):  # texts that fit a segment are hashed together, a longer one alone
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + SEGMENT, "right")) - 1)
            base = int(ends[row])
            block = data[base:int(ends[last])]
            cuts = borders(block)
            for i in range(row, last):
                start, end = int(ends[i]) - base, int(ends[i + 1]) - base
                parts, n = memory.counted(block, cuts, start, end)
                a, b = sorted(int(p) % (n + 1) for p in picks[:, i])
                out[:, i] = n, a, b, memory.place(block, parts, a, n, end) - start, memory.place(block, parts, b, n, end) - start
            row = last
        yield pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "first", "second", "begin", "end"])


def cut_units(text: Column, one: Column, two: Column, units: str = "chars") -> Column:
    """``struct<n, first, second, begin, end>``: the text's number of units, the two numbers modulo
    ``n + 1`` in order, and the bytes before that many units. Null texts are empty, null numbers 0."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _locate(batches, units)

    return F.arrow_udf(run, CUTS)(text, one.cast("long"), two.cast("long"))


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2 ** 32 from the SHA-256 of seed and key; a null key is an empty one."""
    digits = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Sentinels may not overlap each other or themselves, else texts beside them could hold one more."""
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a) or a != b):
                raise ValueError(f"{a!r} and {b!r} overlap")
    return tuple(sentinels)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = "chars", plain: float = 0.1, spm: float = 0.2,
    sentinels: Sequence[str] = SENTINELS, seed: str = "1",
) -> DataFrame:
    """One example per row: ``id, n, form, prefix_units, middle_units, output``.

    A text of ``n`` units is cut after two numbers of units drawn from the id. ``psm`` is prefix
    sentinel, prefix, suffix sentinel, suffix, middle sentinel, middle; ``spm`` begins with suffix
    sentinel and suffix, and goes on with prefix and middle. ``plain`` is the text as it is.

    * ``units`` chars are code points; words are runs without ``[\\x20\\x09-\\x0D]``, and a cut
      after words lies at the beginning of the next one.
    * Null and empty texts are plain and empty. Texts that hold a sentinel are plain, and so is the
      share ``plain`` of the others; ``prefix_units`` and ``middle_units`` are then null.
    * Draws depend on the id and the seed alone: rows that repeat an id share them, null ids too.
    * Texts of any length are read whole, in segments. An empty table gives an empty result;
      other columns are not read.
    """
    if units not in UNITS:
        raise ValueError(f"units is one of {UNITS}")
    p, s, m = _checked(sentinels)
    one, two, three, four = draws(F.col(id_col), seed)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), one.alias("_1"), two.alias("_2"), three.alias("_3"), four.alias("_4"))
    holds = F.lit(False)
    for x in (p, s, m):
        holds = holds | F.contains(F.col("_text"), F.lit(x))
    stays = (F.length("_text") == 0) | holds | (F.col("_3") % 100 >= round(100 * (1 - plain)))
    form = F.when(stays, "plain").when(F.col("_4") % 100 < round(100 * spm), "spm").otherwise("psm")
    cut = base.withColumn("form", form).withColumn("_c", cut_units(F.col("_text"), F.col("_1"), F.col("_2"), units))
    raw = F.col("_text").cast("binary")
    prefix = F.substring(raw, F.lit(1), F.col("_c.begin").cast("int")).cast("string")
    middle = F.substring(raw, (F.col("_c.begin") + 1).cast("int"), (F.col("_c.end") - F.col("_c.begin")).cast("int")).cast("string")
    suffix = F.substring(raw, (F.col("_c.end") + 1).cast("int"), F.octet_length("_text")).cast("string")
    output = F.when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)).when(
        F.col("form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).otherwise(F.col("_text"))
    made = F.col("form") != "plain"
    return cut.select(
        F.col("_id").alias(id_col), F.col("_c.n").alias("n"), "form", F.when(made, F.col("_c.first")).alias("prefix_units"),
        F.when(made, F.col("_c.second") - F.col("_c.first")).alias("middle_units"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an example was made of, from its output and form alone; null for null."""
    between = "|".join("\\Q" + x + "\\E" for x in _checked(sentinels))
    part = F.split(output, between, -1)
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
