"""Token counts by attribution: encode a document once, then say whose tokens they are.

A document is encoded whole, so tokens are those that training would see. Byte lengths of
the tokens give their character spans, and the spans are joined with the sections' intervals;
a token across a border goes where the rule says.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: first: the section of its first character; last: of its last; most: of most of its characters, then the first.
RULES = ("first", "last", "most")
#: Pattern of the rank files' vocabulary, as their description states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space from this length on go round the pattern, whose matcher keeps a stack as deep as the run.
LONG_RUN = 10_000
#: The white space of the pattern's \\s.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
COUNTS = "struct<n_tokens:bigint,outside:bigint,crossing:bigint,sections:array<struct<start:bigint,end:bigint,n:bigint>>>"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoded(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """The tokens of a text, with white space of any length.

    The pattern makes one piece of a run of white space but for its last character, which goes with
    what follows; at the end of the text, of the whole run. Long runs are handed on as that piece.
    """
    out, at = [], 0
    for run in re.finditer(f"[{_BLANK}]{{{LONG_RUN},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoder.encode_ordinary(text[at:run.start()])
        out += encoder._encode_single_piece(text[run.start():end])
        at = end
    return out + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


def _spans(encoder: tiktoken.Encoding, lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of every token; tokens that share a character overlap."""
    ids = np.asarray(encoded(encoder, text), np.int64)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # number of the character that each byte belongs to
    return char[starts], char[ends - 1] + 1


def attribute(first: np.ndarray, after: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int, int]:
    """Tokens of each of the disjoint sections, sorted by start; tokens outside all; tokens across a border."""
    counts = np.zeros(len(starts), np.int64)
    if not len(starts) or not len(first):
        return counts, len(first), 0
    a = np.searchsorted(starts, first, "right") - 1  # the section that begins at or before the first character
    b = np.searchsorted(starts, after - 1, "right") - 1
    in_a = (a >= 0) & (first < ends[a])
    in_b = (b >= 0) & (after - 1 < ends[b])
    across = (a != b) & (in_a | in_b) | (a == b) & (in_a != in_b)
    if rule == "first":
        owner = np.where(in_a, a, -1)
    elif rule == "last":
        owner = np.where(in_b, b, -1)
    else:
        owner = np.where(in_a, a, -1)
        for i in np.flatnonzero(a != b):  # few: only tokens that reach into another section
            lo = max(int(a[i]), 0)
            part = np.minimum(ends[lo:b[i] + 1], after[i]) - np.maximum(starts[lo:b[i] + 1], first[i])
            owner[i] = lo + int(np.argmax(part)) if part.max(initial=0) > 0 else -1
    counts += np.bincount(owner[owner >= 0], minlength=len(starts))
    return counts, int((owner < 0).sum()), int(across.sum())


def _count(batches: Iterator[tuple[pa.Array, pa.Array]], vocabulary: dict[bytes, int], rule: str, lines: bool) -> Iterator[pa.Array]:
    encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, rank in vocabulary.items():
        lengths[rank] = len(token)
    for texts, cuts in batches:
        totals, sections = [], []
        for text, cut in zip(texts, cuts):
            text = text.as_py() or ""
            starts, ends = line_cuts(text) if lines else _pairs(cut)
            order = np.lexsort((ends, starts))
            first, after = _spans(encoder, lengths, text) if text else (np.array([], np.int64),) * 2
            got, outside, crossing = attribute(first, after, starts[order], ends[order], rule)
            counts = np.zeros(len(starts), np.int64)
            counts[order] = got
            totals.append((len(first), outside, crossing))
            sections.append(np.stack([starts, ends, counts]))
        flat = np.concatenate([np.zeros((3, 0), np.int64), *sections], axis=1)
        begins = np.cumsum([0, *[x.shape[1] for x in sections]]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(begins), pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["start", "end", "n"]))
        columns = [pa.array(x) for x in np.array(totals, np.int64).reshape(-1, 3).T]
        yield pa.StructArray.from_arrays([*columns, each], names=["n_tokens", "outside", "crossing", "sections"])


def _pairs(cut: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    given = cut.as_py() or []
    return tuple(np.array([c[k] for c in given], np.int64) for k in ("start", "end"))


def line_cuts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every line, its ``\\n`` included, so the sections cover the text."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    return np.concatenate([[0], ends[:-1]]), ends


def fields_as_sections(fields: Sequence[Column], separator: str = "\n") -> tuple[Column, Column]:
    """Several fields as one text, with a section for each; a null field is an empty one."""
    given = [F.coalesce(x.cast("string"), F.lit("")) for x in fields]
    cuts, at = [], F.lit(0)
    for x in given:
        cuts.append(F.struct(at.alias("start"), (at + F.length(x)).alias("end")))
        at = at + F.length(x) + len(separator)
    return F.concat_ws(separator, *given), F.array(*cuts)


def count_tokens(docs: DataFrame, vocabulary: dict[bytes, int], text: Column, sections: Column | None = None, id_col: str = "doc_id", rule: str = "first") -> DataFrame:
    """Tokens of whole documents, attributed to their sections.

    ``sections`` is an array of ``struct<start, end>`` in characters, end excluded, disjoint;
    without it each line is a section, with its ``\\n``.
    Returns one row per section: ``id, section (from 0), start, end, n_tokens, doc_tokens,
    outside, crossing``. ``outside`` counts the document's tokens in no section, ``crossing``
    those that reach across a border; the sections' tokens and ``outside`` add up to
    ``doc_tokens``.

    * The rule for a token across a border: ``first`` gives it to the section of its first
      character, ``last`` to that of its last, ``most`` to the section with most of its
      characters, the first of equals. A character's bytes may be split over tokens: each
      such token covers the whole character.
    * Texts of any length are encoded whole, runs of white space of any length too (``encoded``).
    * Null and empty texts have no tokens; their sections count 0. A document without
      sections gives one row with null section, start, end and n_tokens.
    * Null ids and repeated rows are counted like others. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    lines = sections is None
    given = F.lit(None).cast("array<struct<start:bigint,end:bigint>>") if lines else F.transform(
        sections, lambda c: F.struct(c.getField("start").cast("long").alias("start"), c.getField("end").cast("long").alias("end")))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), given.alias("_cuts"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary's size does not grow with the data

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _count(batches, held.value, rule, lines)

    said = base.select("_id", F.arrow_udf(run, COUNTS)("_text", "_cuts").alias("_c"))
    each = said.select("_id", "_c.n_tokens", "_c.outside", "_c.crossing", F.posexplode_outer("_c.sections").alias("section", "_z"))
    return each.select(
        F.col("_id").alias(id_col), "section", F.col("_z.start").alias("start"), F.col("_z.end").alias("end"), F.col("_z.n").alias("n_tokens"),
        F.col("n_tokens").alias("doc_tokens"), "outside", "crossing")
