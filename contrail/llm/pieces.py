"""SentencePiece encoding and decoding as a weighted transducer.

A model compiles into three parts that are composed with each input: the normaliser (white
space to its mark, a mark in front), the pieces with one byte piece per byte as fallback, and
for merge models an acceptor of piece pairs. The tropical shortest path through the
composition is the encoding:

* Unigram models weigh a piece by minus its score; the path has the least sum.
* Merge (BPE) models have no additive scores: a greedy merge order decides. But a row of pieces
  is a merge result exactly if each neighbouring pair is the merge result of its own string.
  So a pair weighs 0 if that holds and infinity else, and one path of finite weight is left.
  Up to every position exactly one piece ends a finite path, so a state is a position, and the
  finite path of a string is found depth first, longest piece first: a position from which no
  finite path goes on is left for good. An automaton names the longest piece, and each piece the
  next shorter one that it begins with.

Strings are cut where no piece can reach across: before marks, round line ends and after
letters. Each string between cuts is composed once and remembered as its numbers; where these
spell something else than the string, with those bytes. The memory is bounded and goes with the task.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from string import ascii_letters
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: Strings remembered by a task, in two generations of half as many; pairs by a worker, three quarters of that.
REMEMBER = 400_000
#: A string between cuts that is longer is composed without being remembered.
LONGEST = 64
#: Characters of a text that are cut at once, about.
STRETCH = 1 << 16
INFINITY = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbered fields of a message in the protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        size = {0: 0, 1: 8, 2: -1, 5: 4}[key & 7]
        if not size:
            yield key >> 3, number()
            continue
        size = number() if size < 0 else size
        yield key >> 3, data[at:at + size]
        at += size


class Recent(dict):
    """What was asked for lately. Two generations: a full young one becomes the old one, whose
    entries come back when asked for and are forgotten otherwise. Keys over ``longest`` aren't kept."""

    def __init__(self, size: int, make: Callable[[Any], Any], longest: int | None = None):
        super().__init__()
        self.half, self.make, self.longest, self.old = max(1, size // 2), make, longest, {}

    def __missing__(self, key: Any) -> Any:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if self.longest is not None and len(key) > self.longest:
                return found
        if len(self) >= self.half:
            self.old = dict(self)  # the entries themselves are shared
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Transducer:
    """The compiled model; ``encode`` and ``decode`` are each other's inverse on texts without the mark."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.algorithm, dummy, squeeze, escape, rules, byte_fallback = UNIGRAM, True, True, True, b"", False
        suffix = False
        for field, value in _fields(model):
            if field == 1:
                parts = dict(_fields(value))
                self.pieces.append(parts.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0)
                self.kinds.append(parts.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                self.algorithm, byte_fallback, suffix = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
            elif field == 3:
                norm = dict(_fields(value))
                rules, dummy, squeeze, escape = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        if rules or not escape or suffix or USER in self.kinds or self.algorithm not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models with identity normalisation, marks in front and no user-defined pieces are compiled")
        self.dummy, self.squeeze = dummy, squeeze
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.ids = {p: i for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == BYTE} if byte_fallback else {}
        lowest = min((s for s, kind in zip(self.scores, self.kinds) if kind == NORMAL), default=0.0)
        self.fallback_cost = 10.0 - lowest  # of a character that no piece spells, in unigram models
        self.cut = self._cuts()
        self.spelled = [bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else p.encode()
                        for p, kind in zip(self.pieces, self.kinds)]
        self.parts, self.pairs = Recent(REMEMBER, self._part, LONGEST), Recent(REMEMBER * 3 // 4, self._pair)
        self.marked = self.cut.pattern != "(?s:.+)"
        self.longest = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.longest.add_word(piece, (i, len(piece)))
        self.longest.make_automaton()
        self.reach = max(map(len, self.ids), default=0)
        self.size = len(self.pieces)
        self.span = self.size + 0x110000  # pieces, and characters without one
        self.widths = [len(p) for p in self.pieces]
        self.packed = [struct.pack("=i", i) for i in range(self.size)]
        self.shorter = [-1] * len(self.pieces)
        for piece, i in self.ids.items():
            self.shorter[i] = next((self.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), -1)
        self.trie: dict = {}
        for piece, i in self.ids.items() if self.algorithm == UNIGRAM else ():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = i
        self.sides: dict[str, tuple[list, list] | None] = {}

    def _cuts(self) -> re.Pattern:
        """Strings that no piece reaches across. A piece with a mark after something else, or with a line end and
        more, gives up all cuts; a letter that a piece holds before a non-letter only stops being a place to cut."""
        if any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p and len(p) > 1 for p in self.ids):
            return re.compile("(?s:.+)")
        joined = {p[i] for p in self.ids for i in range(len(p) - 1) if re.match(r"[^\W\d_](?![^\W\d_])", p[i:i + 2])}
        plain = f"[{''.join(sorted({*ascii_letters} - joined)) or '^\\s\\S'}]"
        letter = rf"[^\W\d_{''.join(map(re.escape, sorted(joined)))}]"
        other = rf"(?:(?!{letter}|{MARK}|\n)(?s:.))"
        # most are a mark and plain letters, which are found faster than by their kind
        return re.compile(f"{MARK}{plain}++(?!{letter})|\n|{MARK}+{other}*{letter}*|{other}+{letter}*|{letter}+")

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.dummy else "") + text).replace(" ", MARK)

    def merged(self, text: str, made: list[tuple[str, str, float]] | None = None) -> list[str]:
        """Merge order: the best-scored neighbours first, the leftmost of equals. ``made`` gets the merges."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                break
            if made is not None:
                made.append((parts[at], parts[at + 1], best))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, piece: str) -> tuple[list, list] | None:
        """The symbols that stand at the left and at the right edge of a piece while it is merged,
        each with the score of the merge that ends it. None if the piece isn't the merge result of
        its string, or if a merge's parts score worse than itself: ``accepts`` then merges in full."""
        if piece in self.sides:
            return self.sides[piece]
        made: list[tuple[str, str, float]] = []
        out = None
        if self.merged(piece, made) == [piece]:
            left, right, steady = [], [], all(a[2] >= b[2] for a, b in zip(made, made[1:]))
            x, y = piece[0], piece[-1]
            starts, ends = 1, len(piece) - 1  # made merges in order; those at the edges grow the edge symbols
            for a, b, score in made:
                if a == x and piece.startswith(a + b) and len(a) == starts:
                    left.append((x, score))
                    x, starts = a + b, starts + len(b)
            for a, b, score in made:
                if b == y and piece.endswith(a + b) and len(b) == len(piece) - ends:
                    right.append((y, score))
                    y, ends = a + b, ends - len(a)
            if steady and x == piece and y == piece:
                out = left + [(piece, -INFINITY)], right + [(piece, -INFINITY)]
        self.sides[piece] = out
        return out

    def accepts(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' string leaves exactly them; ``left`` is -1 at the beginning."""
        return self.pairs[(left + 1) * self.span + right]

    def _pair(self, key: int) -> bool:
        size = len(self.pieces)
        left, right = divmod(key, self.span)
        a, b = ("" if x < 0 else self.pieces[x] if x < size else chr(x - size) for x in (left - 1, right))
        return self._stays(a, b) if a else self.merged(b) == [b]

    def _stays(self, left: str, right: str) -> bool:
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return self.merged(left + right) == [left, right]
        ends, starts, ids, scores = a[1], b[0], self.ids, self.scores
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = ends[i], starts[j]
            found = ids.get(x + y)
            if found is not None and scores[found] > until_x and scores[found] >= until_y:
                return False  # the pair across the border merges before either side does
            if until_x == until_y == -INFINITY:
                return True
            if until_x >= until_y:
                i += 1
            else:
                j += 1

    def along(self, text: str, start: int) -> list[tuple[int, int]]:
        """(end, piece) of the pieces that go on from ``start``, the shortest first; a character
        without a piece is its code point above the number of pieces."""
        out, node, at, n = [], self.trie, start, len(text)
        while at < n:
            node = node.get(text[at])
            at += 1
            if node is None:
                break
            found = node.get("")
            if found is not None:
                out.append((at, found))
        if not out or out[0][0] > start + 1:
            out.insert(0, (start + 1, len(self.pieces) + ord(text[start])))
        return out

    def path(self, text: str) -> list[int]:
        """Shortest path through the composition with ``text``: pieces as in ``along``."""
        return self._finite(text) if self.algorithm == MERGES else self._least(text)

    def _finite(self, text: str) -> list[int]:
        """The path of weight 0 through the pairs. Most often the longest piece is right from the beginning on."""
        n, size, span, reach = len(text), self.size, self.span, self.reach
        pairs, widths, shorter, longest = self.pairs, self.widths, self.shorter, self.longest.iter_long
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at = row = 0  # row: where the pairs of the piece before are numbered from
        found, width = -1, 0  # the piece to try at ``at``; -1 if none is left
        if reach:
            for end, (found, width) in longest(text):
                if end + 1 - width != at or not pairs[row + found]:
                    break
                starts.append(at)
                out.append(found)
                row, at = (found + 1) * span, end + 1
        if at == n:
            return out
        ahead = end + 1 - width != at if width else True  # else it is known to fail
        while True:
            if ahead:  # the longest piece that goes on from here; without one, the character as in ``along``
                found = size + ord(text[at])
                for end, (piece, width) in longest(text[at:at + reach]) if reach else ():
                    if end + 1 == width:
                        found = piece
                    break
                ahead = False
                end = at + (widths[found] if found < size else 1)
                ready = end not in dead and pairs[row + found]
            else:
                ready = False
            while not ready:  # the next shorter piece, after the last one the character, after that the piece before
                if found < size and (shorter[found] >= 0 or widths[found] > 1):
                    found = shorter[found] if shorter[found] >= 0 else size + ord(text[at])
                    end = at + (widths[found] if found < size else 1)
                    ready = end not in dead and pairs[row + found]
                else:
                    dead.add(at)
                    at, found = starts.pop(), out.pop()
                    row = (out[-1] + 1) * span if out else 0
            starts.append(at)
            out.append(found)
            row, at, ahead = (found + 1) * span, end, True
            if at == n:
                return out

    def _least(self, text: str) -> list[int]:
        """The path of the least sum of costs; of equal ones, the longer piece."""
        n, size = len(text), len(self.pieces)
        cost, back, width = [INFINITY] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for start in range(n):
            for at, found in self.along(text, start):
                new = cost[start] + (self.fallback_cost if found >= size else -self.scores[found])
                if new < cost[at] or new == cost[at] and at - start > width[at]:
                    cost[at], back[at], width[at] = new, found, at - start
        out, end = [], n
        while end:
            out.append(back[end])
            end -= width[end]
        return out[::-1]

    def _numbers(self, path: list[int]) -> list[int]:
        size = self.size
        out: list[int] = []
        for found in path:
            if found < size:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(found - size).encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _part(self, text: str) -> bytes | tuple[bytes, bytes]:
        """A string between cuts: its numbers, four bytes each; with the bytes that they spell if these are others than its own."""
        path = self.path(text)
        if max(path, default=0) < self.size and "".join([self.pieces[x] for x in path]) == text:
            return b"".join([self.packed[x] for x in path])
        numbers = self._numbers(path)
        raw, spelled = array("i", numbers).tobytes(), b"".join(map(self.spelled.__getitem__, numbers))
        return raw if spelled == text.encode("utf-8", "replace") else (raw, spelled)

    def _stretches(self, text: str) -> Iterator[str]:
        """A normalised text in stretches of about STRETCH, each ending where strings are cut: before a mark
        that begins a run. What a text needs beside its result doesn't grow with its length."""
        at = 0
        while self.marked and len(text) - at > STRETCH:
            end = text.find(MARK, at + STRETCH)
            while 0 < end and text[end - 1] == MARK:
                end = text.find(MARK, end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:] if at else text

    def both(self, text: str) -> tuple[bytes, bytes]:
        """The numbers of a text, four bytes each, and the bytes that they spell."""
        numbers, spelled = [], []
        for stretch in self._stretches(self.normalise(text)):
            strings = self.cut.findall(stretch)
            found = list(map(self.parts.__getitem__, strings))
            if not self.bytes:
                numbers.append(self._unknown_once(found))
                continue
            try:
                numbers.append(b"".join(found))
                spelled.append("".join(strings).encode("utf-8", "replace"))
            except TypeError:  # some string isn't what its numbers spell
                numbers.append(b"".join([x[0] if type(x) is tuple else x for x in found]))
                spelled.append(b"".join([x[1] if type(x) is tuple else y.encode("utf-8", "replace") for x, y in zip(found, strings)]))
        if not self.bytes:  # unknown characters in a row are one, across cuts, too
            whole = self._unknown_once(numbers)
            return whole, b"".join(map(self.spelled.__getitem__, array("i", whole)))
        return b"".join(numbers), b"".join(spelled)

    def _unknown_once(self, found: list[bytes | tuple[bytes, bytes]]) -> bytes:
        numbers: list[int] = []
        for x in found:
            more = array("i", x[0] if type(x) is tuple else x)
            numbers.extend(more[1:] if numbers and more and numbers[-1] == more[0] == self.unknown else more)
        return array("i", numbers).tobytes()

    def encode(self, text: str) -> list[int]:
        return array("i", self.both(text)[0]).tolist()

    def said(self, raw: bytes) -> str:
        """The text of spelled bytes: UTF-8, marks as white space, the mark in front dropped."""
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text

    def decode(self, numbers: list[int]) -> str:
        """Pieces joined, byte pieces as UTF-8."""
        return self.said(b"".join(map(self.spelled.__getitem__, numbers)))


@lru_cache(maxsize=2)
def machine_of(model: bytes) -> Transducer:
    """Compiled once in a worker. Its tasks share the model and its pairs, whose number the model bounds."""
    return Transducer(model)


@contextmanager
def at_work(model: bytes) -> Iterator[Transducer]:
    """The machine for one task: strings are forgotten behind it, so that other work finds the memory free."""
    machine = machine_of(model)
    try:
        yield machine
    finally:
        machine.parts.forget()


def load(path: str) -> bytes:
    with open(path, "rb") as model:
        return model.read()


def _lists(raw: list[bytes | None]) -> pa.ListArray:
    """Lists of numbers from their bytes, as one flat array."""
    ends = np.zeros(len(raw) + 1, np.int32)
    np.cumsum([0 if x is None else len(x) // 4 for x in raw], out=ends[1:])
    values = np.frombuffer(b"".join([x for x in raw if x is not None]), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()), mask=pa.array([x is None for x in raw], pa.bool_()))


def _encode_all(batches: Iterator[pa.Array], model: bytes) -> Iterator[pa.Array]:
    with at_work(model) as machine:
        for texts in batches:
            yield _lists([None if x is None else machine.both(x)[0] for x in (t.as_py() for t in texts)])


def _decode_all(batches: Iterator[pa.Array], model: bytes) -> Iterator[pa.Array]:
    machine = machine_of(model)
    for rows in batches:
        out = [None if x is None else machine.decode([i for i in x if i is not None]) for x in (r.as_py() for r in rows)]
        yield pa.array(out, pa.string())


def encode(text: Column, model: bytes) -> Column:
    """Piece numbers of a text; null for null, empty for the empty text. Texts of any length."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _encode_all(batches, model)

    return F.arrow_udf(run, "array<int>")(text)


def decode(numbers: Column, model: bytes) -> Column:
    """Text of piece numbers; null for null. Null numbers are skipped, control pieces give nothing."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _decode_all(batches, model)

    return F.arrow_udf(run, "string")(numbers)


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tokens, n_tokens, round_trip``, one row per input row.

    * ``round_trip`` says whether the tokens decode to the text; it fails only for texts that
      hold the mark character, or where the model's normaliser changes the text.
    * Null texts have null tokens, n_tokens 0 and a null round_trip; empty texts have none.
    * Null ids and repeated rows are encoded like others; an empty table gives an empty
      result; other columns are not read.
    """
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with at_work(model) as machine:
            for texts in batches:
                raw, same = [], []
                for text in texts:
                    text = text.as_py()
                    numbers, spelled = (None, None) if text is None else machine.both(text)
                    raw.append(numbers)
                    same.append(None if text is None else machine.said(spelled) == text)
                yield pa.StructArray.from_arrays([_lists(raw), pa.array(same, pa.bool_())], names=["tokens", "round_trip"])

    said = docs.select(F.col(id_col).alias("_id"), F.arrow_udf(both, "struct<tokens:array<int>,round_trip:boolean>")(F.col(text_col)).alias("_e"))
    return said.select(F.col("_id").alias(id_col), F.col("_e.tokens").alias("tokens"), F.when(F.col("_e.tokens").isNull(), 0).otherwise(F.size("_e.tokens")).cast("long").alias("n_tokens"),
                       F.col("_e.round_trip").alias("round_trip"))
