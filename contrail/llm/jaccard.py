"""N-gram Jaccard join by universe partitioning.

The universe of shingles is hashed into segments, as many as the size band of a set asks for.
Two sets whose Jaccard similarity reaches 3/4 differ in at most (|a| + |b|) / 7 shingles, so if
a set allots one more than that over its segments - 1 to segments that must be equal, 2 to those
that may differ by one shingle (its one-deletion neighbourhood) - some segment must match.
Which segments is a matter of cost:

1. Every set sends all its segments' signatures to buckets. A segment no other set has costs
   nothing; a set with enough of those has no partner and is done. Almost all sets end here.
2. The others allot: segments of their own first, then the rarest shared ones, or second units
   on segments of their own, whichever finds fewer sets, so frequent passages are hardly ever
   looked up. What a second unit would find is asked in buckets, too.
3. Looked-up signatures meet the indexed ones in buckets. Only the components are wanted, so in
   a first round each run of equal signatures tests its members against the smallest one; in a
   second round, members of a run that are in different components by then: as pairs, or, when
   the run is long, by an index inside blocks of members. All links are verified on whole sets.

Bands: sets up to SMALL shingles have each shingle for a segment; above, bands grow by 4/3, so
partners are in one band or the next, and a set also has signatures in the segments of the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.session import stage

from .common import partitions, released, released_group, small_batches

SHINGLE = 5
SMALL = 64
SLACK = 1.3
#: Cost of looking a signature up, in candidates.
LOOKUP = 0.1
#: A shared segment with no more others than this is taken without asking what second units find.
CHEAP = 4
#: Up to so many ids of live sets, 8 bytes each, are broadcast.
FEW_IDS = 1_000_000
NEVER = 1e18
#: Bytes of text handled at once, and entries of a bucket, about.
CHUNK = 1_000_000
BUCKET = 1_000_000
BATCH_SETS = 16_384
#: Runs of more members than this are met in blocks of about MET_ROWS members, not as pairs.
LONG_RUN = 16
MET_ROWS = 1024
#: Links that a task joins at once.
LINKS_AT_ONCE = 250_000

U = np.uint64
# Odd constants of a generator, not of meaning: they make the hash functions.
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=U) * U(2) + U(1)
_BASE, _BAND, _SEG, _GONE = (U(x) for x in _RNG.integers(1, 2**63, 4, dtype=U) * U(2) + U(1))
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


_TOPS = [SMALL]  # largest set of each band
while _TOPS[-1] < 1 << 40:
    _TOPS.append(_TOPS[-1] * 4 // 3)
_TOPS = np.array(_TOPS)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_KNOWN: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "powers" in _KNOWN and len(_KNOWN["powers"][0]) >= n:
        return _KNOWN["powers"]
    up, down = np.full(n, _BASE, U), np.full(n, _INVERSE, U)
    up[0] = down[0] = U(1)
    _KNOWN["powers"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _KNOWN["powers"]


def _sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of texts lying one after another in ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~space
    first = np.flatnonzero(word & (np.concatenate(([True], space[:-1])) | edge[:-1]))
    after = np.flatnonzero(word & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
    up, down = _powers(1 << max(20, (n + 1).bit_length()))
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    words = mix((sums[after] - sums[first]) * down[first] + (after - first).astype(U))
    of = np.searchsorted(offsets, first, "right") - 1  # document of each word
    counts = np.bincount(of, minlength=len(offsets) - 1)
    begins = np.concatenate(([0], np.cumsum(counts)))
    grams = np.zeros(len(words), U)
    for i in range(min(SHINGLE, len(words))):
        grams[:len(words) - i] += words[i:] * _PLACE[i]
    grams = mix(grams)
    keep, sizes = [], np.zeros(len(counts), np.int64)
    for d in range(len(counts)):
        k, at = int(counts[d]), int(begins[d])
        if not k:
            continue
        if k < SHINGLE:  # the whole sequence is one shingle
            own = mix((words[at:at + k] * _PLACE[:k]).sum(keepdims=True) + np.array([k], U) * _GONE)
        else:
            own = np.sort(grams[at:at + k - SHINGLE + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        keep.append(own)
        sizes[d] = len(own)
    return (np.concatenate(keep) if keep else np.zeros(0, U)), np.concatenate(([0], np.cumsum(sizes)))


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of a text column: (first row, row after the last, hashes, offsets of the rows' sets)."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        end = min(end, len(texts))
        yield (at, end, *_sets_of(data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]))
        at = end


def band_of(sizes: np.ndarray) -> np.ndarray:
    """0 up to SMALL; band b holds sizes up to SMALL * (4/3)^b."""
    out = np.zeros(len(sizes), np.int64)
    big = sizes > SMALL
    out[big] = np.searchsorted(_TOPS, sizes[big])
    return out


def segments(bands: np.ndarray) -> np.ndarray:
    """Segments of a band; band 0 has a segment per shingle."""
    return np.ceil(SLACK * (2 * _TOPS[bands] // 7 + 1)).astype(np.int64)


class Signatures:
    """Signatures of sets in the segments of their own band (role 0) or the next (role 1)."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, role: int):
        sizes = np.diff(offsets)
        self.bands = band_of(sizes) + role
        self.owner = np.repeat(np.arange(len(sizes)), sizes)  # set of each shingle
        if role:  # of sets that may have a partner in the next band
            reach = (sizes * 4 // 3 > _TOPS[self.bands - 1])[self.owner]
            hashes, self.owner = hashes[reach], self.owner[reach]
        band = self.bands[self.owner]
        seg = ((hashes >> U(32)) * segments(band).astype(U)) >> U(32)
        single = band == 0
        new = np.ones(len(hashes), bool)
        new[1:] = (self.owner[1:] != self.owner[:-1]) | (seg[1:] != seg[:-1]) | single[1:]
        self.starts = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1  # segment of each shingle
        self.set = self.owner[self.starts]
        self.count = np.diff(np.append(self.starts, len(hashes)))
        self.total = np.add.reduceat(hashes, self.starts) if len(hashes) else hashes
        self.salt = band.astype(U) * _BAND + np.where(single, U(0), seg * _SEG)
        self.hashes = hashes
        self.keys = mix(self.total + self.salt[self.starts])
        # Band and segment as one number; in band 0 a segment is a shingle, and has no second unit.
        self.spot = np.where(single, 0, band << 40 | seg.astype(np.int64))[self.starts]

    def deletions(self, least: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of segments of ``least`` shingles or more less one shingle each, and their sets."""
        fit = (self.count >= least)[self.of]
        if only is not None:
            fit &= only[self.of]
        return mix(self.total[self.of[fit]] - self.hashes[fit] + self.salt[fit]), self.owner[fit]


def _pack(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key; the high ones name the bucket."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(40)) * U(buckets) >> U(24)).astype(np.int64)


def digests(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; empty sets get 0."""
    size = np.diff(offsets)
    full = size > 0
    out = []
    for salt in np.array([[1], [2]], U):
        value = np.zeros(len(size), U)
        if full.any():
            value[full] = mix(np.add.reduceat(mix(hashes + salt * _GONE), offsets[:-1][full]) + size[full].astype(U))
        out.append(value.view(np.int64))
    return out[0], out[1]


# ---- first pass: sizes, digests, signatures that no other set has

PROFILE = "_id long, _mark long, _n long, _c1 long, _c2 long, _own long, _low long"


@released
def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digests and number of non-empty segments in both roles of each text's set."""
    for batch in batches:
        for a, b, hashes, offsets in shingle_sets(batch.column(1)):
            c1, c2 = digests(hashes, offsets)
            n = len(c1)
            filled = [np.bincount(Signatures(hashes, offsets, role).set, minlength=n) if len(hashes) else np.zeros(n, np.int64) for role in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(a, b - a).cast(pa.int64()) for k in (0, 2)), *map(pa.array, (np.diff(offsets), c1, c2, *(f.astype(np.int64) for f in filled)))],
                names=["_id", "_mark", "_n", "_c1", "_c2", "_own", "_low"])


BLOBS = "_bucket int, _sets binary, _of binary, _keys binary"


def _blobs(sets: np.ndarray, of: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[dict]:
    """Rows of one bucket each: sets' ids, and entries of a set's place there and a key."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, of, keys = bucket[order], of[order], keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        used, place = np.unique(of[a:b] >> 2, return_inverse=True)
        yield {"_bucket": int(bucket[a]), "_sets": sets[used].tobytes(), "_of": (place.astype(np.uint32) << 2 | of[a:b] & 3).astype(
            np.uint16 if len(used) <= BATCH_SETS else np.uint32).tobytes(), "_keys": _pack(keys[a:b])}


def _rows(made: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(made, schema=pa.schema(list(kinds.items())))


_BLOB = {"_bucket": pa.int32(), "_sets": pa.binary(), "_of": pa.binary(), "_keys": pa.binary()}


@released
def _all_signatures(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of all exact signatures, of several chunks at a time."""
    held: list[tuple] = []
    n = entries = 0

    def out() -> pa.RecordBatch:
        sets, of, keys = (np.concatenate(x) for x in zip(*held))
        return _rows(list(_blobs(sets, of, keys, buckets)), _BLOB)

    for batch in batches:
        for _, _, hashes, offsets in shingle_sets(batch.column(0)):
            c1, _ = digests(hashes, offsets)
            for role in (0, 1) if len(hashes) else ():
                s = Signatures(hashes, offsets, role)
                held.append((c1 if not role else c1[:0], (s.set + n << 2 | role).astype(np.int64), s.keys))
                entries += len(s.keys)
            n += len(c1) if len(hashes) else 0
            if entries >= BUCKET or n >= BATCH_SETS // 2:
                yield out()
                held, n, entries = [], 0, 0
    if held:
        yield out()


def _entries(table: pa.Table, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All blobs of a bucket: sets' values (``width`` numbers each), keys, flags."""
    sets, keys, flags = [], [], []
    for ids, of, packed in zip(table.column("_sets"), table.column("_of"), table.column("_keys")):
        own = np.frombuffer(ids.as_buffer(), np.int64).reshape(-1, width)
        keys.append(_unpack(packed.as_py()))
        raw = of.as_buffer()
        place = np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(keys[-1]) else np.uint32)
        sets.append(own[place >> 2])
        flags.append((place & 3).astype(np.uint8))
    return np.concatenate(sets), np.concatenate(keys), np.concatenate(flags)


BY_SET = "_group int, _sets binary, _flags binary, _keys binary, _counts binary"
_BY_SET = {"_group": pa.int32(), "_sets": pa.binary(), "_flags": pa.binary(), "_keys": pa.binary(), "_counts": pa.binary()}


def _to_groups(sets: np.ndarray, flags: np.ndarray, keys: np.ndarray, counts: np.ndarray, groups: int) -> pa.Table:
    """Rows on their way back from buckets to sets: a row for each group of sets, whatever their number."""
    group = (mix(sets.view(U)) % U(groups)).astype(np.int64)
    order = np.lexsort((sets, group))
    sets, flags, keys, counts, group = sets[order], flags[order], keys[order], counts[order], group[order]
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(group)) if len(group) else cuts
    made = [{"_group": int(group[a]), "_sets": sets[a:b].tobytes(), "_flags": flags[a:b].astype(np.uint8).tobytes(), "_keys": _pack(keys[a:b]),
             "_counts": _saturated(counts[a:b])} for a, b in zip(cuts, ends)]
    return pa.Table.from_batches([_rows(made, _BY_SET)])


GATHERED = "_c1 long, _s0 long, _s1 long, _keys binary, _counts binary"


def _gathered(table: pa.Table) -> pa.Table:
    """One row per set: how many signatures came back for either role, their low bits and counts."""
    sets = np.frombuffer(b"".join(table.column("_sets").to_pylist()), np.int64)
    flags, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8) for c in ("_flags", "_counts"))
    keys = np.frombuffer(b"".join(table.column("_keys").to_pylist()), np.uint8).reshape(-1, 5)
    order = np.argsort(sets, kind="stable")
    sets, flags, counts, keys = sets[order], flags[order], counts[order], keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], sets[1:] != sets[:-1]))) if len(sets) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(sets)) if len(sets) else cuts
    low = np.add.reduceat((flags & 1).astype(np.int64), cuts) if len(sets) else cuts
    return pa.table({
        "_c1": sets[cuts], "_s0": ends - cuts - low, "_s1": low,
        "_keys": pa.array([keys[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        "_counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())})


@released_group
def _shared(table: pa.Table, groups: int) -> pa.Table:
    """Of one bucket, the signatures that several sets have, and how many."""
    sets, keys, flags = _entries(table)
    sets = sets[:, 0]
    order = np.lexsort((sets, keys))
    keys = keys[order]  # one by one: each frees its unsorted form
    sets = sets[order]
    flags = flags[order]
    del order
    if len(keys):  # copies of a set count once
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])))
        keys, sets, flags = keys[fresh], sets[fresh], flags[fresh]
    run = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    size = np.bincount(run)[run] if len(run) else run
    many = size > 1
    return _to_groups(sets[many], flags[many], keys[many], size[many], groups)


def _saturated(numbers: np.ndarray) -> bytes:
    """Counts as bytes; they only price a choice, so 255 stands for more."""
    return np.minimum(numbers, 255).astype(np.uint8).tobytes()


def need(sizes: np.ndarray, role: int, larger: bool) -> np.ndarray:
    """Units that a set must allot to be sure of a partner at least as small, or (larger) up to 4/3 its size."""
    band = band_of(sizes)
    if role == 0:
        most = np.minimum(sizes * 4 // 3, _TOPS[band]) if larger else sizes
        out = (sizes + most) // 7 + 1
        return np.where(band == 0, sizes // 4 + 1, out)  # with a segment per shingle only the set's missing ones count
    return (sizes + sizes * 4 // 3) // 7 + 1


def allot(s: Signatures, n_sets: int, first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shared segments get a unit, and which of a set's own segments get a second one.

    ``first`` is the number of other sets with the signature, 0 for a segment of the set's own,
    and ``second`` the number of sets that looking up its one-deletion neighbourhood finds. Units
    on own segments come first and need no lookup; what is missing is the cheapest of the rest.
    """
    own = first == 0
    lack = need(sizes, 0, False) - np.bincount(s.set[own], minlength=n_sets)
    double = own & (s.count >= 2)
    price = np.where(double, second + LOOKUP * (s.count + 1), np.where(own, NEVER, first))
    order = np.lexsort((price, s.set))
    owner = s.set[order]
    begins = np.searchsorted(owner, np.arange(n_sets))
    rank = np.arange(len(order)) - begins[owner]
    chosen = np.zeros(len(order), bool)
    chosen[order] = rank < lack[owner]
    return chosen & ~own, chosen & double


# ---- second pass: candidates among sets that share much

LIVE = "_rep long, _n long, _role0 boolean, _role1 boolean, _set binary, _first binary, _next binary, _spots array<bigint>"
_LIVE = {"_rep": pa.int64(), "_n": pa.int64(), "_role0": pa.bool_(), "_role1": pa.bool_(), "_set": pa.binary(), "_first": pa.binary(), "_next": pa.binary(),
         "_spots": pa.list_(pa.int64())}
LOW = U((1 << 40) - 1)


def _numbers_of(keys: bytes | None, counts: bytes | None, wanted: np.ndarray) -> np.ndarray:
    """Counts that go with the low bits of the wanted keys; 0 for others."""
    if not keys:
        return np.zeros(len(wanted))
    have, number = _unpack(keys), np.frombuffer(counts, np.uint8)
    order = np.argsort(have, kind="stable")
    have, number = have[order], number[order]
    place = np.minimum(np.searchsorted(have, wanted & LOW), len(have) - 1)
    return np.where(have[place] == (wanted & LOW), number[place], 0).astype(float)


@released
def _live_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole set of each live text, if the text still is the expected one: the number of other sets at
    each segment, bits for the shared ones of the next band, and the spots whose second units it may want."""
    for batch in batches:
        given, digest = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for a, b, hashes, offsets in shingle_sets(batch.column(1)):
            c1, _ = digests(hashes, offsets)
            s, low = Signatures(hashes, offsets, 0), Signatures(hashes, offsets, 1)
            at, low_at = (np.searchsorted(x.set, np.arange(b - a + 1)) for x in (s, low))
            wanted = need(np.diff(offsets), 0, False)
            made = []
            for d in np.flatnonzero(c1 == digest[a:b]):
                lo, hi = at[d], at[d + 1]
                known = batch.column(5)[a + d].as_py(), batch.column(6)[a + d].as_py()
                first = np.maximum(_numbers_of(*known, s.keys[lo:hi]) - 1, 0)
                lack = int(wanted[d] - (first == 0).sum())
                shared = np.sort(first[first > 0])
                # Units that a few candidates pay for need no second thoughts.
                asks = lack > 0 and (lack > len(shared) or shared[lack - 1] > CHEAP)
                made.append({
                    "_rep": int(given[a + d]), "_n": int(offsets[d + 1] - offsets[d]), "_role0": batch.column(3)[a + d].as_py(), "_role1": batch.column(4)[a + d].as_py(),
                    "_set": hashes[offsets[d]:offsets[d + 1]].tobytes(), "_first": first.astype(np.uint8).tobytes(),
                    "_next": np.packbits(_numbers_of(*known, low.keys[low_at[d]:low_at[d + 1]]) > 0).tobytes(),
                    "_spots": s.spot[lo:hi][(first == 0) & (s.count[lo:hi] >= 2)].tolist() if asks else []})
            yield _rows(made, _LIVE)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of live sets, a bounded volume at a time, with their hashes and offsets."""
    step = 0
    while step < batch.num_rows:
        volume, end = 0, step
        while end < batch.num_rows and end - step < BATCH_SETS // 2 and (end == step or volume <= CHUNK * 4):
            volume += len(batch.column(4)[end].as_buffer())
            end += 1
        part = batch.slice(step, end - step)
        sets = [np.frombuffer(x.as_buffer(), U) for x in part.column(4)]
        yield part, np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        step = end


ALLOTTED = "_rep long, _once binary, _twice binary, _spots array<bigint>"


@released
def _allotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit per segment for a unit on a shared one, and for a second unit on an own one; the spots of the latter."""
    for batch in batches:
        for part, hashes, offsets in _groups(batch):
            s = Signatures(hashes, offsets, 0)
            n = part.num_rows
            at = np.searchsorted(s.set, np.arange(n + 1))
            first = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column(5)]).astype(float)
            second = np.full(len(s.keys), NEVER)  # no set does what it hasn't asked about, unless nothing else is left
            gone, _ = s.deletions(1)
            for d in range(n):
                if part.column(7)[d].as_py():
                    lo, hi = at[d], at[d + 1]
                    second[lo:hi] = np.bincount(s.of[offsets[d]:offsets[d + 1]] - lo, _numbers_of(
                        part.column(8)[d].as_py(), part.column(9)[d].as_py(), gone[offsets[d]:offsets[d + 1]]), hi - lo)
            once, twice = allot(s, n, first, second, np.diff(offsets))
            bits = [pa.array([np.packbits(x[at[d]:at[d + 1]]).tobytes() for d in range(n)], pa.binary()) for x in (once, twice)]
            spots = pa.array([s.spot[at[d]:at[d + 1]][twice[at[d]:at[d + 1]]].tolist() for d in range(n)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), *bits, spots], names=["_rep", "_once", "_twice", "_spots"])


INDEX, PROBE = 1, 2


def _indexed(part: pa.RecordBatch, hashes: np.ndarray, offsets: np.ndarray, spots: np.ndarray, lacking: bool) -> tuple[Signatures, list, list]:
    """Signatures that others may look up, in both roles: of shared segments, of any segment at the spots
    where someone has a second unit, and there (if ``lacking``) less one shingle."""
    keys, of = [], []
    for role in (1, 0):
        s = Signatures(hashes, offsets, role)
        live = np.array(part.column(2 + role).to_pylist(), bool)[s.set]
        here = live & np.isin(s.spot, spots)
        if lacking:
            width = np.bincount(s.set, minlength=part.num_rows)
            raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in part.column(5 + role)]
            shared = np.concatenate([x > 0 if role == 0 else np.unpackbits(x, count=int(c)).astype(bool) for x, c in zip(raw, width)])
            gone, owner = s.deletions(3, here)
            keys.append(mix(gone + _GONE))
            of.append(owner.astype(np.int64) << 2 | INDEX)
            here = live & (shared | here)
        keys.append(s.keys[here])
        of.append(s.set[here].astype(np.int64) << 2 | INDEX)
    return s, keys, of


def _ask(new: np.ndarray, sets: np.ndarray, keys: list, of: list) -> None:
    keys.append(new)
    of.append(sets.astype(np.int64) << 2 | PROBE)


@released
def _questions(batches: Iterator[pa.RecordBatch], buckets: int, spots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blobs to learn what second units would find in sets that lack one shingle, of sets that want to know."""
    for batch in batches:
        for part, hashes, offsets in _groups(batch):
            s, keys, of = _indexed(part, hashes, offsets, spots, False)
            asks = np.array([len(x) > 0 for x in part.column(7).to_pylist()], bool)
            first = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column(5)])
            _ask(*s.deletions(2, (first == 0) & asks[s.set]), keys, of)
            yield _rows(list(_blobs(part.column(0).to_numpy(), np.concatenate(of), np.concatenate(keys), buckets)), _BLOB)


@released_group
def _answers(table: pa.Table, groups: int) -> pa.Table:
    """For each set that asks in a bucket, the signatures that others index there, and how many."""
    sets, keys, flags = _entries(table)
    sets = sets[:, 0]
    order = np.argsort(keys, kind="stable")
    sets, keys, flags = sets[order], keys[order], flags[order]
    run = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    found = np.bincount(run[flags == INDEX], minlength=run[-1] + 1 if len(run) else 0)[run] if len(run) else run
    hit = (flags == PROBE) & (found > 0)
    return _to_groups(sets[hit], flags[hit], keys[hit], found[hit], groups)


@released
def _lookups(batches: Iterator[pa.RecordBatch], buckets: int, spots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blobs of the live sets: indexed and looked-up signatures."""
    for batch in batches:
        for part, hashes, offsets in _groups(batch):
            s, keys, of = _indexed(part, hashes, offsets, spots, True)
            width = np.bincount(s.set, minlength=part.num_rows)
            once, twice = (np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=int(c)) for x, c in zip(part.column(k), width)]).astype(bool)
                           for k in (7, 8))
            _ask(s.keys[once], s.set[once], keys, of)
            _ask(*s.deletions(2, twice), keys, of)  # the partner lacks a shingle
            _ask(mix(s.keys[twice] + _GONE), s.set[twice], keys, of)  # or has one more
            values = np.stack([part.column(k).to_numpy().astype(np.int64) for k in (0, 1, 9)], axis=1)
            yield _rows(list(_blobs(values, np.concatenate(of), np.concatenate(keys), buckets)), _BLOB)


PAIRS = "_a long, _b long"


def _runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members (id, size, root) of runs of equal signatures, their flags, and the runs' bounds:
    runs with a lookup and an indexed signature, of different sets. Members are in order of id."""
    sets, keys, flags = _entries(table, 3)
    order = np.lexsort((sets[:, 0], keys))
    sets, keys, flags = sets[order], keys[order], flags[order]
    if not len(keys):
        return sets, flags, keys.astype(np.int64), keys.astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (sets[1:, 0] != sets[:-1, 0]))))
    flags = np.bitwise_or.reduceat(flags, fresh)
    sets, keys = sets[fresh], keys[fresh]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    end = np.append(begin[1:], len(keys))
    held = (np.bitwise_or.reduceat(flags, begin) == INDEX | PROBE) & (end - begin > 1)
    return sets, flags, begin[held], end[held]


@released_group
def _stars(table: pa.Table) -> pa.Table:
    """Distinct pairs of each run's smallest member with the others, if their sizes allow a link."""
    sets, _, begin, end = _runs(table)
    size = end - begin
    head = np.repeat(begin, size)
    rest = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + head
    fit = (rest != head) & _alike(sets[head, 1], sets[rest, 1])
    found = np.unique(np.stack([sets[head[fit], 0], sets[rest[fit], 0]], axis=1), axis=0)
    return pa.table({"_a": found[:, 0], "_b": found[:, 1]})


CROSS = "_group long, _a long, _b long"


@released_group
def _cross(table: pa.Table) -> pa.Table:
    """Of runs whose members are not all joined yet: pairs of members that are not, or, of long runs,
    no pairs but rows (component of the smallest member, member, whether it looks up)."""
    sets, flags, begin, end = _runs(table)
    pairs, members = [np.zeros((0, 2), np.int64)], [np.zeros((0, 3), np.int64)]
    root = sets[:, 2]
    for a, b in zip(begin, end):
        if (root[a:b] == root[a]).all():
            continue
        asks = flags[a:b] & PROBE > 0
        if b - a > LONG_RUN:
            members.append(np.stack([np.full(b - a, root[a]), sets[a:b, 0], asks], axis=1))
        else:
            fit = asks[:, None] & (flags[a:b] & INDEX > 0) & (root[a:b, None] != root[a:b]) & _alike(sets[a:b, 1][:, None], sets[a:b, 1])
            x, y = np.nonzero(fit)
            pairs.append(np.sort(np.stack([sets[a + x, 0], sets[a + y, 0]], axis=1), axis=1))
        if len(pairs) > 2000:
            pairs = [np.unique(np.concatenate(pairs), axis=0)]
        if len(members) > 50:
            members = [np.unique(np.concatenate(members), axis=0)]
    two, three = np.unique(np.concatenate(pairs), axis=0), np.unique(np.concatenate(members), axis=0)
    return pa.table({
        "_group": pa.concat_arrays([pa.nulls(len(two), pa.int64()), pa.array(three[:, 0], pa.int64())]),
        "_a": np.concatenate((two[:, 0], three[:, 1])), "_b": np.concatenate((two[:, 1], three[:, 2]))})


@released_group
def _met(block: pa.Table) -> pa.Table:
    """Links between sets that look up and sets of other components, both in blocks: one link for
    each asking set and component. Overlaps are counted by an index of the shingles."""
    out: list[tuple[int, int]] = []
    left, right = block.filter(block.column("_left")), block.filter(pc.invert(block.column("_left")))
    if left.num_rows and right.num_rows:
        ids, sizes, roots = (right.column(c).to_numpy() for c in ("_x", "_n", "_root"))
        often, number = np.unique(roots, return_counts=True)
        often = often[np.argmax(number)]

        def index(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sets = [np.frombuffer(right.column("_set")[int(i)].as_buffer(), U) for i in rows]
            token = np.concatenate(sets) if sets else np.zeros(0, U)
            owner = np.repeat(rows, [len(x) for x in sets]) if sets else rows
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
            return token[first], np.append(first, len(token)), owner

        whole, few = index(np.arange(len(ids))), index(np.flatnonzero(roots != often))
        for x, n, root, raw in zip(*(left.column(c).to_pylist() for c in ("_x", "_n", "_root")), left.column("_set")):
            tokens, bounds, owner = few if root == often else whole
            if not len(tokens):
                continue
            own = np.frombuffer(raw.as_buffer(), U)
            at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
            at = at[tokens[at] == own]
            if not len(at):
                continue
            both = np.bincount(np.concatenate([owner[bounds[i]:bounds[i + 1]] for i in at]), minlength=len(ids))
            hit = np.flatnonzero((100 * both >= 75 * (sizes + n - both)) & (roots != root))
            _, one = np.unique(roots[hit], return_index=True)
            out.extend((x, int(ids[i])) for i in hit[one])
    return pa.table({"_a": pa.array([a for a, _ in out], pa.int64()), "_b": pa.array([b for _, b in out], pa.int64())})


def met_in_blocks(members: DataFrame, live: DataFrame) -> DataFrame:
    """Links inside the groups of ``_group, _a (member), _b (1 if it looks up)``, block by block of members."""
    each = members.groupBy("_group", F.col("_a").alias("_x")).agg(F.max("_b").alias("_asks"))
    width = each.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / MET_ROWS).cast("int").alias("_w"))
    each = each.join(width, "_group").withColumn("_own", F.pmod(F.xxhash64("_x"), F.col("_w")).cast("int"))
    each = each.join(live.select(F.col("_rep").alias("_x"), "_n", "_root", "_set"), "_x")
    every = F.explode(F.sequence(F.lit(0), F.col("_w") - 1))
    key = ["_group", "_l", "_r"]
    left = each.where("_asks = 1").select("_group", F.col("_own").alias("_l"), every.alias("_r"), "_x", "_n", "_root", "_set", F.lit(True).alias("_left"))
    right = each.select("_group", every.alias("_l"), F.col("_own").alias("_r"), "_x", "_n", "_root", "_set", F.lit(False).alias("_left"))
    return left.unionByName(right).groupBy(*key).applyInArrow(_met, PAIRS)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (4 * a >= 3 * b) & (4 * b >= 3 * a)


@released
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets reach the similarity."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            if len(a) > len(b):
                a, b = b, a
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
            ok.append(100 * both >= 75 * (len(a) + len(b) - both))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["_a", "_b"])


SKETCH_BITS = 2048
SKETCHED = "_rep long, _n long, _sketch binary"


@released
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity of the number of shingles that hash to each bit: where two sketches differ, the sets do."""
    for batch in batches:
        bits = [np.packbits((np.bincount((np.frombuffer(x.as_buffer(), U) & U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()
                for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["_rep", "_n", "_sketch"])


@released
def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches differ in no more bits than linked sets can differ in shingles."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), U).reshape(batch.num_rows, -1) for k in (4, 5))
        apart = np.bitwise_count(x ^ y).sum(axis=1)
        keep = pa.array(apart <= (batch.column(2).to_numpy() + batch.column(3).to_numpy()) // 7)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["_a", "_b"])


def verified(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """Pairs that are links; whole sets travel only for pairs that their sketches allow."""
    small = live.select("_rep", "_n", "_set").mapInArrow(_sketches, SKETCHED)
    x, y = (small.select(F.col("_rep").alias(to), F.col("_n").alias(n), F.col("_sketch").alias(k)) for to, n, k in (("_a", "_na", "_ka"), ("_b", "_nb", "_kb")))
    near = pairs.join(x, "_a").join(y, "_b").select("_a", "_b", "_na", "_nb", "_ka", "_kb").mapInArrow(_hopeful, PAIRS)
    near = stage(near, "hopeful")
    x, y = (live.select(F.col("_rep").alias(to), F.col("_set").alias(k)) for to, k in (("_a", "_x"), ("_b", "_y")))
    return near.join(x, "_a").join(y, "_b").select("_a", "_b", "_x", "_y").mapInArrow(_linked, PAIRS)


@released
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links as stars, a bounded number at once: each node with the smallest one that these links join it to."""
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        nodes, place = np.unique(np.concatenate(held), return_inverse=True)
        a, b = place.reshape(-1, 2).T
        root = np.arange(len(nodes))
        while (apart := root[a] != root[b]).any():
            x, y = root[a[apart]], root[b[apart]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
        far = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["_a", "_b"])

    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1))
        if sum(map(len, held)) >= LINKS_AT_ONCE:
            yield stars()
            held = []
    if held:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """``_node, _root``: the smallest node of each connected component, for nodes with an edge.

    Tasks first join what their own links join. Then large and small stars in turn (Kiveris and
    others): each node hands its neighbours on to the smallest one, until every node hangs on its
    root. Rounds grow with the logarithm of the longest path; each is cut off as a written table.
    """
    edges = stage(edges.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).where("_a <> _b").distinct(), "links")
    tasks = max(1, -(-edges.count() // LINKS_AT_ONCE))
    edges = stage(edges.coalesce(tasks).mapInArrow(_joined, PAIRS), "links")
    done = tasks == 1  # one task's stars are whole
    while not done:
        both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m"))
        large = both.join(least, "_a").where(F.col("_b") > F.col("_a")).select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).where("_a <> _b")
        large = large.distinct()
        down = large.groupBy("_a").agg(F.min("_b").alias("_m"))
        small = large.join(down, "_a")
        small = small.select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).where("_a <> _b").unionByName(down.select("_a", F.col("_m").alias("_b")))
        edges = stage(small.distinct(), "links")
        roots = edges.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"))
        # Done when every node has one edge and no root is a node: the graph is stars.
        tangled = roots.where("_n > 1").select("_a").unionByName(edges.select(F.col("_b").alias("_a")).join(roots.select("_a"), "_a", "left_semi"))
        done = tangled.isEmpty()
    return edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_root")).unionByName(edges.select(F.col("_b").alias("_node"), F.col("_b").alias("_root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

    Returns one row per input row: ``id, n_shingles, component_id`` (the smallest id reachable).

    * Words are runs without ASCII white space, A-Z in lower case; a text of fewer than five
      words is one shingle; null, empty and blank texts have none and link with nothing.
    * Equal sets are one class from the start, so copies cost one set whatever their number.
    * Ids are integers. A row with a null id takes part in no link and has a null component;
      rows that repeat an id get the component of the text each has, and link with each other
      only through their texts.
    * An empty table gives an empty result. Other columns are not read.

    Shingles and sets are known by 64-bit hashes, classes by 128 bits. Signatures travel as
    5 bytes inside blocks; a bucket's size follows from the number of buckets, which grows with
    the shingles. A signature that a third of the sets share fills its bucket with one entry
    per set and batch, never with pairs.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    marked = base.withColumn("_mark", F.xxhash64("_text"))
    profile = stage(marked.mapInArrow(_profile, PROFILE), "sets")
    # A class has a number of its own: an id may stand on texts of several classes. One text of it is found by id and mark.
    classes = profile.where("_id is not null and _n > 0").groupBy("_c1", "_c2", "_n").agg(
        F.min(F.struct("_id", "_mark")).alias("_text_of"), F.max("_own").alias("_own"), F.max("_low").alias("_low"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("_rep"), "_c1", "_c2", "_n", "_text_of._id", "_text_of._mark", "_own", "_low"), "classes")
    entries = profile.agg(F.sum(F.col("_own") + F.col("_low"))).first()[0] or 0
    buckets = max(partitions(spark), -(-entries // BUCKET))

    blobs = base.where("_id is not null").select("_text").mapInArrow(lambda it: _all_signatures(it, buckets), BLOBS)
    groups = partitions(spark)
    shared = blobs.groupBy("_bucket").applyInArrow(lambda t: _shared(t, groups), BY_SET).groupBy("_group").applyInArrow(_gathered, GATHERED)
    # A set with enough segments of its own in a role has no partner there.
    n = F.col("_n")
    least = F.when(n <= SMALL, F.floor(n / 4) + 1).otherwise(F.floor((n + n) / 7) + 1)
    role0 = (F.col("_own") - F.col("_s0")) < least + F.when(n <= SMALL, 0).otherwise(F.floor(n / 21) + 1)
    role1 = (F.col("_low") > 0) & ((F.col("_low") - F.col("_s1")) < F.floor((n + F.floor(n * 4 / 3)) / 7) + 1)
    live = classes.join(shared, "_c1").withColumns({"_role0": role0, "_role1": role1}).where("_role0 or _role1")
    live = stage(live.select("_rep", "_id", "_mark", "_c1", "_role0", "_role1", "_keys", "_counts"), "live")
    texts = marked
    if live.count() <= FEW_IDS:  # the ids keep other texts out of the shuffle; beyond, the join does it alone
        texts = marked.join(F.broadcast(live.select("_id")), "_id", "left_semi")
    texts = texts.join(live, ["_id", "_mark"]).dropDuplicates(["_id", "_mark", "_rep"])  # rows that repeat an id and its text
    texts = texts.select("_rep", "_text", "_c1", "_role0", "_role1", "_keys", "_counts")
    # The sets meet many narrow tables by id: written in buckets, they need not move again.
    name, parts = f"sets_{uuid.uuid4().hex}", partitions(spark)
    texts.mapInArrow(_live_sets, LIVE).repartition(parts, "_rep").write.bucketBy(parts, "_rep").sortBy("_rep").saveAsTable(name)
    try:
        return _join_sets(profile, classes, spark.table(name), buckets, id_col)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _spots_of(sets: DataFrame) -> np.ndarray:
    """Distinct spots: no more than the segments of all bands, so bounded by the longest text."""
    return np.array(sorted(r[0] for r in sets.select(F.explode("_spots")).distinct().collect()), np.int64)


def _join_sets(profile: DataFrame, classes: DataFrame, live: DataFrame, buckets: int, id_col: str) -> DataFrame:
    """Allot, look up, verify, and name the components of all rows."""
    columns = ["_rep", "_n", "_role0", "_role1", "_set", "_first", "_next"]
    asked = _spots_of(live)
    blobs = live.select(*columns, "_spots").mapInArrow(lambda it: _questions(it, buckets, asked), BLOBS)
    groups = partitions(profile.sparkSession)
    told = blobs.groupBy("_bucket").applyInArrow(lambda t: _answers(t, groups), BY_SET).groupBy("_group").applyInArrow(_gathered, GATHERED)
    told = told.select(F.col("_c1").alias("_rep"), "_keys", "_counts")
    wise = live.join(told, "_rep", "left") if len(asked) else live.withColumns({c: F.lit(None).cast("binary") for c in ("_keys", "_counts")})
    units = stage(wise.select(*columns, "_spots", "_keys", "_counts").mapInArrow(_allotted, ALLOTTED), "units")
    spots = _spots_of(units)
    units = units.drop("_spots")

    def looked_up(root: DataFrame) -> DataFrame:
        rows = live.join(root, "_rep").select(*columns, "_once", "_twice", "_root")
        return rows.mapInArrow(lambda it: _lookups(it, buckets, spots), BLOBS).groupBy("_bucket")

    stars = looked_up(units.withColumn("_root", F.col("_rep"))).applyInArrow(_stars, PAIRS).distinct()
    roots = components(verified(stars, live))
    known = roots.select(F.col("_node").alias("_rep"), "_root")
    ranked = units.join(known, "_rep", "left").withColumn("_root", F.coalesce("_root", "_rep"))
    cross = stage(looked_up(ranked).applyInArrow(_cross, CROSS).distinct(), "cross")
    second = verified(cross.where("_group is null").select("_a", "_b"), live)
    joined = live.select("_rep", "_n", "_set").join(known, "_rep", "left").withColumn("_root", F.coalesce("_root", "_rep"))
    second = stage(second.unionByName(met_in_blocks(cross.where("_group is not null"), joined)), "pairs")
    if not second.isEmpty():
        more = second.join(roots.select(F.col("_node").alias("_a"), F.col("_root").alias("_ra")), "_a", "left").join(
            roots.select(F.col("_node").alias("_b"), F.col("_root").alias("_rb")), "_b", "left")
        top = components(more.select(F.coalesce("_ra", "_a").alias("_a"), F.coalesce("_rb", "_b").alias("_b"))).select(F.col("_node").alias("_root"), F.col("_root").alias("_top"))
        lone = more.where("_ra is null").select(F.col("_a").alias("_node")).unionByName(more.where("_rb is null").select(F.col("_b").alias("_node"))).distinct()
        roots = roots.unionByName(lone.select("_node", F.col("_node").alias("_root")))
        roots = roots.join(top, "_root", "left").select("_node", F.coalesce("_top", "_root").alias("_root"))
    # Only now are components named by ids.
    ids = classes.select(F.col("_rep").alias("_node"), F.col("_id").alias("_least"))
    least = roots.join(ids, "_node").groupBy("_root").agg(F.min("_least").alias("_component"))
    roots = roots.join(least, "_root").select("_node", "_component")
    named = classes.join(roots, F.col("_rep") == F.col("_node"), "left").select(
        F.col("_c1").alias("_k1"), F.col("_c2").alias("_k2"), F.col("_n").alias("_kn"), F.coalesce("_component", "_id").alias("_component"))
    out = profile.join(named, (F.col("_c1") == F.col("_k1")) & (F.col("_c2") == F.col("_k2")) & (F.col("_n") == F.col("_kn")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id")).alias("component_id"))
