"""Cheapest repair of conversations, by a Viterbi search that runs on chunks at once.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. That is a machine
of four states; a row offers edits between them, and the costs to finish from each state are a
vector of four numbers that every row updates from the one behind it. Chunks of rows work on this
in parallel, all but the last from a vector that is only a guess. Choices depend on differences
within a vector, so a chunk is right as soon as its vector differs from the true one by a constant
only: fix-up passes hand each chunk the vector of the chunk behind it, and rerun it until both
vectors are parallel. Where they don't become parallel in ``PASSES`` (rows that keep, say, a
parity), the chunks' matrices are multiplied in as many rounds as the logarithm of their number.
The vectors, stitched, say which edits are cheapest; the first of them in ASCII order is taken.

The search reads one letter per row. Texts are sorted once and joined to their edits once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.session import stage

from .common import SPACES

#: A chunk has up to 2 ** CHUNK_BITS rows.
CHUNK_BITS = 12
#: Fix-up passes before matrices take over.
PASSES = 3
DELETE, REROLE, INSERT, CUT_SHORT = 3, 2, 2, 1
#: States: nothing yet, after the system's row, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of the next role leads, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
#: Costs to finish behind the last row, insertions included.
END = (0, 2 * INSERT, INSERT, 0)
GUESS = (0, 0, 0, 0)
NEVER = 1 << 40
# A row's letter is its role's initial (s, u, a, other) times four and its fault.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
KEYS = ["_none", "_conv"]
ROUTE = "struct<acts:array<string>,cost:bigint,illegal:bigint,blank:bigint,duplicate:bigint,truncated:bigint>"


def keeps(initial: int, state: int) -> int:
    """The state after a row of this initial is kept, or -1."""
    if initial == 0:
        return SYSTEM if state == EMPTY else -1
    if initial == 1:
        return USER if state != USER else -1
    return ASSISTANT if initial == 2 and state == USER else -1


class Machine:
    """Steps from vector to vector, remembered: their differences are bounded, so there are few."""

    def __init__(self) -> None:
        self.steps: dict[tuple, tuple] = {}
        self.routes: dict[tuple, tuple] = {}

    def before(self, behind: tuple, letter: int) -> tuple[int, ...]:
        """Costs to finish in front of a row, from those behind it."""
        initial, fault = divmod(letter, 4)
        here = [DELETE + behind[s] for s in range(4)]
        if fault in (FINE, TRUNCATED):
            more = CUT_SHORT * (fault == TRUNCATED)
            for s in range(4):
                to = keeps(initial, s)
                here[s] = min(here[s], REROLE + more + behind[NEXT[s]], more + behind[to] if to >= 0 else NEVER)
        to_user, to_assistant = min(here[USER], INSERT + here[ASSISTANT]), min(here[ASSISTANT], INSERT + here[USER])
        return min(here[EMPTY], INSERT + to_user), min(here[SYSTEM], INSERT + to_user), to_user, to_assistant

    def step(self, behind: tuple, letter: int) -> tuple[int, ...]:
        """The same, less the least cost: vectors that differ by a constant become equal."""
        found = self.steps.get((behind, letter))
        if found is None:
            new = self.before(behind, letter)
            found = self.steps[behind, letter] = tuple(x - min(new) for x in new)
        return found

    def back(self, letters: str, behind: tuple) -> tuple[int, ...]:
        for x in reversed(letters):
            behind = self.step(behind, ord(x) - 65)
        return behind

    def fixed(self, letters: str, was: tuple, now: tuple, made: tuple) -> tuple[int, ...]:
        """The chunk's vector when ``now`` stands behind it, if it was ``made`` when ``was`` did."""
        for x in reversed(letters):
            if was == now:
                return made
            was, now = self.step(was, ord(x) - 65), self.step(now, ord(x) - 65)
        return now

    def matrix(self, letters: str) -> list[int]:
        """The least cost between the states at both ends of a chunk, in rows."""
        out = []
        for end in range(4):
            vector, far = tuple(0 if s == end else NEVER for s in range(4)), 0
            for x in reversed(letters):
                new = self.before(vector, ord(x) - 65)
                far += min(new)
                vector = tuple(min(NEVER, v - min(new)) for v in new)
            out.append([min(NEVER, v + far) if v < NEVER else NEVER for v in vector])
        return [out[end][start] for start in range(4) for end in range(4)]

    def route(self, behind: tuple, letter: int, state: int) -> tuple[str, int, int]:
        """The cheapest edits at a row, the first in ASCII order: act, state behind the row, cost.

        An act names inserted rows by u and a, then D (deleted), K (kept), U or A (made user's or assistant's).
        """
        found = self.routes.get((behind, letter, state))
        if found is None:
            initial, fault = divmod(letter, 4)
            free, more = fault in (FINE, TRUNCATED), CUT_SHORT * (fault == TRUNCATED)
            costs, act, spent, s = self.before(behind, letter), "", 0, state
            while True:
                left = costs[s]
                if left == DELETE + behind[s]:
                    found = act + "D", s, spent + DELETE
                elif left == INSERT + costs[NEXT[s]]:
                    act, spent, s = act + ("u" if NEXT[s] == USER else "a"), spent + INSERT, NEXT[s]
                    continue
                elif free and keeps(initial, s) >= 0 and left == more + behind[keeps(initial, s)]:
                    found = act + "K", keeps(initial, s), spent + more
                else:
                    found = act + ("U" if NEXT[s] == USER else "A"), NEXT[s], spent + REROLE + more
                break
            self.routes[behind, letter, state] = found
        return found

    def vectors(self, letters: str, behind: tuple) -> list[tuple]:
        """The vector behind every row of a chunk."""
        out = []
        for x in reversed(letters):
            out.append(behind)
            behind = self.step(behind, ord(x) - 65)
        return out[::-1]

    def ends(self, letters: str, behind: tuple) -> list[int]:
        """The state behind the chunk for every state in front of it."""
        states = [0, 1, 2, 3]
        for x, vector in zip(letters, self.vectors(letters, behind)):
            after = [self.route(vector, ord(x) - 65, s)[1] for s in range(4)]
            states = [after[s] for s in states]
        return states

    def trace(self, letters: str, behind: tuple, state: int, last: bool) -> dict[str, Any]:
        acts, cost = [], 0
        for x, vector in zip(letters, self.vectors(letters, behind)):
            act, state, more = self.route(vector, ord(x) - 65, state)
            acts.append(act)
            cost += more
        if last and state in (SYSTEM, USER):
            acts[-1] += "ua" if state == SYSTEM else "a"
            cost += INSERT * (2 if state == SYSTEM else 1)
        faults, roles = [(ord(x) - 65) % 4 for x in letters], [(ord(x) - 65) // 4 for x in letters]
        return {"acts": acts, "cost": cost, "illegal": sum(p not in ((0, 1), (1, 2), (2, 1)) for p in zip(roles, roles[1:])),
                "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}


_ROUTE = pa.struct([("acts", pa.list_(pa.string())), *[(c, pa.int64()) for c in ("cost", "illegal", "blank", "duplicate", "truncated")]])


def _each(method: str, kind: pa.DataType, sql: str, *columns: Column) -> Column:
    """A method of the machine on every row; arrays arrive as tuples."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = getattr(Machine(), method)
        for batch in batches:
            rows = zip(*[x.to_pylist() for x in batch.flatten()])
            yield pa.array([call(*[tuple(v) if isinstance(v, list) else v for v in row]) for row in rows], kind)

    return F.arrow_udf(run, sql)(F.struct(*columns))


_INTS = (pa.list_(pa.int32()), "array<int>")
_LONGS = (pa.list_(pa.int64()), "array<bigint>")


def _vector(v: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(x).cast("int") for x in v])


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by the checksum of conversation and turn: a fifth of them in all.
    A null is one space, in the checksum and as a role or text."""
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    out = rows.select(
        F.col(conv_col), F.col(turn_col), F.when(fault == 4, F.lit("user")).otherwise(role).alias(role_col),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("_times"))
    return out.withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times")


def _letters(ordered: DataFrame) -> DataFrame:
    """``keys, _n, _turn, _letter``; a row is a duplicate if its role and text came earlier in its conversation."""
    same = [*KEYS, "_same"]
    # a group of equal rows is counted on the map side, and few groups have more than one row
    firsts = ordered.groupBy(*same).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1").drop("_times")
    slim = ordered.select(*same, "_n", "_turn", "_initial", "_fault").join(firsts, same, "left")
    fault = F.when(F.col("_fault") == BLANK, BLANK).when(F.col("_n") > F.col("_first"), DUPLICATE).otherwise(F.col("_fault"))
    return slim.select(*KEYS, "_n", "_turn", F.chr(65 + 4 * F.col("_initial") + fault).alias("_letter"))


def _chunks(letters: DataFrame) -> DataFrame:
    """``keys, _chunk, _letters, _start, no, of, _next``: chunks numbered within their conversation;
    ``_next`` is the first letter of the chunk behind."""
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_letter")))
    rows = letters.groupBy(*KEYS, F.shiftright("_n", CHUNK_BITS).alias("_chunk")).agg(F.min("_n").alias("_start"), ordered.alias("_rows"))
    rows = stage(rows.select(*KEYS, "_chunk", "_start", F.array_join(F.transform("_rows", lambda r: r["_letter"]), "").alias("_letters")), "conv-chunks")
    # the window sees one small row for each chunk, without its letters
    line = Window.partitionBy(*KEYS).orderBy("_chunk")
    numbers = rows.select(*KEYS, "_chunk", F.substring("_letters", 1, 1).alias("_head")).select(
        *KEYS, "_chunk", F.row_number().over(line).cast("long").alias("no"), F.count(F.lit(1)).over(Window.partitionBy(*KEYS)).alias("of"), F.lead("_head").over(line).alias("_next"))
    return stage(rows.join(numbers, [*KEYS, "_chunk"]), "conv-numbered")


def _shifted(table: DataFrame, step: int, **columns: str) -> DataFrame:
    """The columns of the chunk ``step`` places on, beside the keys and number of this one."""
    return table.select(*KEYS, (F.col("no") - step).alias("no"), *[F.col(a).alias(b) for b, a in columns.items()])


def _stitched(many: DataFrame) -> DataFrame:
    """``_given`` for every chunk of conversations with several: the vector behind it, less a constant."""
    guess = F.when(F.col("no") == F.col("of"), _vector(END)).otherwise(_vector(GUESS))
    now = many.select(*KEYS, "no", "of", "_letters", guess.alias("_given"))
    now = stage(now.withColumn("_made", _each("back", *_INTS, F.col("_letters"), F.col("_given"))), "conv-pass")
    for _ in range(PASSES):
        seen = now.join(_shifted(now, 1, _behind="_made"), [*KEYS, "no"], "left").withColumn("_behind", F.coalesce("_behind", "_given"))
        seen = seen.withColumn("_new", F.when(F.col("_behind") == F.col("_given"), F.col("_made")).otherwise(
            _each("fixed", *_INTS, F.col("_letters"), F.col("_given"), F.col("_behind"), F.col("_made"))))
        now = stage(seen.select(*KEYS, "no", "of", "_letters", F.col("_behind").alias("_given"), F.col("_new").alias("_made"), (F.col("_new") != F.col("_made")).alias("_moved")), "conv-pass")
        if now.where("_moved").isEmpty():
            return now.select(*KEYS, "no", "_given")
    return _multiplied(many)


def _multiplied(many: DataFrame) -> DataFrame:
    """The same from matrices, whose products double their reach in every round."""
    reach = stage(many.select(*KEYS, "no", "of", _each("matrix", *_LONGS, F.col("_letters")).alias("_m")), "conv-matrix")
    longest, step = reach.agg(F.max("of")).first()[0] or 1, 1
    entry = lambda m, i, j: F.get(m, F.lit(4 * i + j))
    while step < longest:
        both = reach.join(_shifted(reach, step, _o="_m"), [*KEYS, "no"], "left")
        product = F.array(*[F.least(F.lit(NEVER), *[entry("_m", i, k) + entry("_o", k, j) for k in range(4)]) for i in range(4) for j in range(4)])
        reach = stage(both.select(*KEYS, "no", "of", F.when(F.col("_o").isNull(), F.col("_m")).otherwise(product).alias("_m")), "conv-matrix")
        step *= 2
    finish = [F.least(*[entry("_m", i, j) + F.lit(END[j]) for j in range(4)]) for i in range(4)]
    vector = F.array(*[(x - F.least(*finish)).cast("int") for x in finish])
    done = reach.select(*KEYS, "no", vector.alias("_v"))
    return many.select(*KEYS, "no").join(_shifted(done, 1, _given="_v"), [*KEYS, "no"], "left").withColumn("_given", F.coalesce("_given", _vector(END)))


def _entered(many: DataFrame) -> DataFrame:
    """``_state`` in front of every chunk: the chunks' maps of states, composed in doubling rounds."""
    maps = stage(many.select(*KEYS, "no", "of", _each("ends", *_INTS, F.col("_letters"), F.col("_given")).alias("_m")), "conv-states")
    longest, step = maps.agg(F.max("of")).first()[0] or 1, 1
    while step < longest:
        both = maps.join(_shifted(maps, -step, _o="_m"), [*KEYS, "no"], "left")
        composed = F.transform("_o", lambda s: F.get(F.col("_m"), s))
        maps = stage(both.select(*KEYS, "no", "of", F.coalesce(composed, F.col("_m")).alias("_m")), "conv-states")
        step *= 2
    return many.select(*KEYS, "no").join(_shifted(maps, -1, _o="_m"), [*KEYS, "no"], "left").select(*KEYS, "no", F.coalesce(F.get("_o", F.lit(EMPTY)), F.lit(EMPTY)).alias("_state"))


@dataclass
class Repair:
    """``summary``: a row per conversation; ``rows``: a row per given row, with ``act`` and ``lines``, in the order of ``place``."""

    summary: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Cheapest edits that make every conversation's role initials read ``(s?(ua)+)?``.

    Keeping a row costs 0, another role (user, assistant) 2, deletion 3, an empty row of user or
    assistant, anywhere, 2; rows that stay truncated cost 1 more; blank and duplicate rows are
    deleted. Of the cheapest edits those whose initials (Delete, Insert, Keep, Rerole), in order,
    come first in ASCII are taken.

    ``summary`` has ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``; ``rows`` has
    ``conv, turn, role, text, place, act, lines``: ``lines`` are the ``role:text`` that the row
    becomes, with rows inserted beside it, or null if none.

    * Rows go by turn, nulls first; of a turn by role, then by a digest of role and text. Repeated
      rows are rows. A null role or text is one space; null conversations are one conversation.
    * A row's first fault counts: blank (without a character other than ``[\\x20\\x09-\\x0D]``),
      duplicate (role and text came earlier), truncated (the last such character is not ``.!?``).
    * Texts of any length are digested whole. An empty table gives empty results; other columns
      are not read.

    A conversation of any share of the rows is spread: rows are range-partitioned with the row as
    the last key, and worked on in chunks. Only the audit, one string, meets in one place.
    """
    conv = F.col(conv_col)
    kind = rows.schema[conv_col].dataType
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    ended = F.rtrim(F.col("_text"), F.lit(SPACES))
    base = rows.select(conv.isNull().alias("_none"), F.coalesce(conv.cast("string"), F.lit("")).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"),
                       F.monotonically_increasing_id().alias("_row"))
    base = base.withColumns({
        "_same": F.sha2(F.concat_ws("\x00", "_role", "_text").cast("binary"), 256),
        "_initial": F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("_role", 1, 1)), F.lit(0)),
        "_fault": F.when(ended == "", BLANK).when(F.substring(ended, -1, 1).isin(*".!?"), FINE).otherwise(TRUNCATED)})
    base = base.withColumn("_initial", F.when(F.col("_initial") == 0, 3).otherwise(F.col("_initial") - 1).cast("int"))
    order = [*KEYS, F.col("_turn").asc_nulls_first(), "_role", "_same", "_row"]
    # the number of a row follows its range and its place there: a conversation's rows are consecutive in a range
    ordered = stage(base.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()).drop("_row"), "conv-rows")
    letters = stage(_letters(ordered), "conv-letters")
    chunks = _chunks(letters)
    many = chunks.where("of > 1")
    if many.isEmpty():
        ready = chunks.withColumn("_given", _vector(END)).withColumn("_state", F.lit(EMPTY))
    else:
        given = stage(many.join(_stitched(many), [*KEYS, "no"]), "conv-given")
        found = stage(given.join(_entered(given), [*KEYS, "no"]).select(*KEYS, "no", "_given", "_state"), "conv-entered")
        ready = chunks.join(found, [*KEYS, "no"], "left").withColumns({"_given": F.coalesce("_given", _vector(END)), "_state": F.coalesce("_state", F.lit(EMPTY))})
    routed = ready.withColumn("_r", _each("trace", _ROUTE, ROUTE, F.col("_letters"), F.col("_given"), F.col("_state"), F.col("no") == F.col("of")))
    initial = lambda c: F.floor((F.ascii(c) - 65) / 4)
    pair = initial(F.substring("_letters", -1, 1)) * 4 + initial("_next")
    across = F.when(F.col("_next").isNotNull() & ~pair.isin(0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1), 1).otherwise(0)
    routed = stage(routed.select(*KEYS, "no", "_start", "_r.*", across.alias("_across")), "conv-routes")

    audit = F.translate(F.array_join("acts", ""), "uaUA", "IIRR")
    whole = routed.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("_across")).cast("long").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct("no", audit.alias("audit")))).alias("_audits"))
    turns = letters.groupBy(*KEYS, "_turn").agg(F.count(F.lit(1)).alias("_c")).groupBy(*KEYS).agg(
        F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count("_turn"), F.lit(0)).cast("long").alias("gaps"))
    back = F.when(~F.col("_none"), F.col("_conv")).cast(kind).alias(conv_col)
    summary = whole.join(turns, KEYS).select(
        back, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join(F.transform("_audits", lambda a: a["audit"]), "").alias("audit"))

    acts = routed.select("_start", F.posexplode("acts").alias("_at", "act")).select((F.col("_start") + F.col("_at")).alias("_n"), "act")
    joined = ordered.join(acts, "_n")
    said = lambda word: F.transform(F.split(word, ""), lambda x: F.when(x == "u", F.lit("user:")).otherwise(F.lit("assistant:")))
    first, last = F.regexp_extract("act", "^[ua]+", 0), F.regexp_extract("act", "[ua]+$", 0)
    own = F.regexp_extract("act", "[DKUA]", 0)
    kept = F.when(own == "U", F.lit("user")).when(own == "A", F.lit("assistant")).when(own == "K", F.col("_role"))
    empty = F.array().cast("array<string>")
    lines = F.concat(F.when(first != "", said(first)).otherwise(empty), F.when(kept.isNotNull(), F.array(F.concat(kept, F.lit(":"), F.col("_text")))).otherwise(empty),
                     F.when(last != "", said(last)).otherwise(empty))
    return Repair(summary, joined.select(
        back, F.col("_turn").alias(turn_col), F.col("_role").alias(role_col), F.col("_text").alias(text_col), F.col("_n").alias("place"), "act",
        F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("lines")))


def digests(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv, sha256`` of a conversation's lines, in the order of place, joined by line ends.

    One digest runs over all its bytes in order, so a conversation passes through one task; it
    passes in small batches, sorted outside memory, and nothing but the running digest is held.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    said = rows.where("lines is not null").select(F.col(conv_col).alias("_conv"), "place", F.col("lines").cast("binary").alias("_lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = run  # no key is equal to it
        running = None
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for key, line in zip(keys, batch.column(2)):
                if now is run or key != now:
                    if running is not None:
                        out.append((now, running.hexdigest()))
                    now, running = key, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(line.as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.column(0).type), pa.array([s for _, s in out])], names=[conv_col, "sha256"])
            last = batch.column(0).type
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], last), pa.array([running.hexdigest()])], names=[conv_col, "sha256"])

    return said.repartition("_conv").sortWithinPartitions("_conv", "place").mapInArrow(run, f"`{conv_col}` {kind}, sha256 string")
