"""Licence scans: one automaton finds notices and tags, a parser reads licence expressions.

Texts become bytes of lower-case words with one space around each, so a phrase with spaces
at both ends matches whole words only; an Aho-Corasick automaton finds all phrases in one
pass. Where the SPDX tag stands, the rest of its line is parsed by shunting-yard and valued.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels, as the results name them.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notices, and what they stand for.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc", "boost software license": "bsl",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "released into the public domain": "public-domain", "unlicense": "unlicense", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# How far a licence binds, from free to closed.
DUTY = {"public": 0, "permissive": 1, "weak": 2, "strong": 3, "limited": 4, "closed": 5}
# What the notices' labels bind to.
LABELS = {
    "apache": "permissive", "bsd": "permissive", "bsl": "permissive", "cc-by": "permissive", "isc": "permissive", "mit": "permissive", "cc0": "public",
    "public-domain": "public", "unlicense": "public", "epl": "weak", "lgpl": "weak", "mpl": "weak", "agpl": "strong", "cc-by-sa": "strong", "gpl": "strong",
    "cc-by-nc": "limited", "cc-by-nd": "limited", "proprietary": "closed",
}
# Identifiers by family: whole names in lower case, versions as patterns.
_GNU, _CC = "(-only|-or-later)?", r"-(1\.0|2\.0|2\.5|3\.0|4\.0)"
FAMILIES = {kind: re.compile("|".join(names)) for kind, names in {
    "public": ["0bsd", r"cc0-1\.0", "unlicense", r"pddl-1\.0", "wtfpl"],
    "permissive": [
        r"afl-(1\.1|1\.2|2\.0|2\.1|3\.0)", r"apache-(1\.0|1\.1|2\.0)", r"artistic-2\.0", r"blueoak-1\.0\.0", "bsd-[1-4]-clause(-[a-z0-9-]+)?", r"bsl-1\.0", "cc-by" + _CC, "curl",
        r"ecl-[12]\.0", "ftl", "hpnd", "ijg", "isc", r"libpng(-2\.0)?", "mit(-0|-cmu|-feh|-modern-variant)?", r"mulanpsl-[12]\.0", "ncsa", "openssl", r"php-3\.01?", "postgresql",
        r"psf-2\.0", r"python-2\.0(\.1)?", "ruby", "tcl", r"unicode-3\.0", r"upl-1\.0", "vim", "w3c", "x11", "zlib", r"zpl-(1\.1|2\.0|2\.1)"],
    "weak": [r"artistic-1\.0(-perl|-cl8)?", r"cddl-1\.[01]", r"cpl-1\.0", r"epl-[12]\.0", r"eupl-1\.[0-2]", r"ipl-1\.0", r"lgpl-(2\.0|2\.1|3\.0)" + _GNU, r"mpl-(1\.0|1\.1|2\.0)", "ms-pl", "ms-rl"],
    "strong": [r"agpl-[13]\.0" + _GNU, "cc-by-sa" + _CC, r"gfdl-1\.[1-3]" + _GNU, r"gpl-[123]\.0" + _GNU, r"osl-(1\.0|1\.1|2\.0|2\.1|3\.0)", r"qpl-1\.0", "sleepycat", r"sspl-1\.0"],
    "limited": [r"busl-1\.1", "cc-by-(nc|nd|nc-nd|nc-sa)" + _CC, r"elastic-2\.0"],
    "closed": ["(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", "noassertion", "none"],
}.items()}
EXCEPTIONS = re.compile(
    r"autoconf-exception-(2\.0|3\.0)|bison-exception-2\.2|bootloader-exception|classpath-exception-2\.0|font-exception-2\.0|gcc-exception-(2\.0|3\.1)|gpl-cc-1\.0|"
    r"libtool-exception|linux-syscall-note|llvm-exception|openvpn-openssl-exception|qt-gpl-exception-1\.0|swift-exception|universal-foss-exception-1\.0|wxwindows-exception-3\.1")
RANK = {"OR": 1, "AND": 2, "WITH": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
#: Upper-case letters to lower, all bytes that are no letter, digit or part of a longer character to a space.
WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class BadExpression(ValueError):
    pass


def postfix(text: str) -> list[str]:
    """Shunting-yard: operators in order of binding WITH, AND, OR, all to the left."""
    out: list[str] = []
    wait: list[str] = []
    operand = True  # whether one is due
    for token in _TOKEN.findall(text):
        word = token.upper()
        if token == "(" or word not in RANK and token != ")":
            if not operand:
                raise BadExpression(text)
            if token == "(":
                wait.append(token)
            else:
                out.append(token)
                operand = False
            continue
        if operand:
            raise BadExpression(text)
        if token == ")":
            while wait and wait[-1] != "(":
                out.append(wait.pop())
            if not wait:
                raise BadExpression(text)
            wait.pop()
            continue
        while wait and wait[-1] != "(" and RANK[wait[-1]] >= RANK[word]:
            out.append(wait.pop())
        wait.append(word)
        operand = True
    if operand or "(" in wait:
        raise BadExpression(text)
    return out + wait[::-1]


class UnknownName(BadExpression):
    pass


def duty(name: str) -> int:
    """How far an identifier binds; a trailing + allows later versions and changes nothing here."""
    name = name.lower().removesuffix("+")
    for kind, names in FAMILIES.items():
        if names.fullmatch(name):
            return DUTY[kind]
    raise UnknownName(name)


def evaluate(text: str) -> tuple[int, list[str]]:
    """Value of an expression and the licences it names: OR lets one choose the freest, AND binds to
    the strictest, WITH and an exception lighten a strong copyleft by one step. Names are whole
    identifiers; an exception stands behind WITH and nowhere else."""
    names: list[str] = []
    stack: list[int | str] = []  # a name waits for its value, since it may be an exception

    def value(x: int | str) -> int:
        if isinstance(x, str):
            names.append(x.lower())
            return duty(x)
        return x

    for token in postfix(text):
        if token not in RANK:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "WITH":
            if not isinstance(left, str) or not isinstance(right, str) or not EXCEPTIONS.fullmatch(right.lower()):
                raise BadExpression(text)
            found = value(left)
            stack.append(DUTY["weak"] if found == DUTY["strong"] else found)
        else:
            stack.append((min if token == "OR" else max)(value(left), value(right)))
    return value(stack[0]), names


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in dict.fromkeys([*BASE, *NOTICES, TAG]):
        found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton) -> dict:
    raw = text or ""
    words = raw.encode("utf-8", "replace").translate(WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = list(machine.iter(line))
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "expressions": [], "spans": []}
    if not hits:
        return out
    base, labels, expressions, spans, strictest = set(), set(), [], [], 0.0
    seen = upto = 0  # words before a place: hits come by their end, so the count goes on from the last
    for end, (phrase, n) in hits:
        seen += line.count(" ", upto, end)
        upto = end
        start = seen - n
        if phrase == TAG:
            continue
        label = BASE.get(phrase) or NOTICES[phrase]
        labels.add(label)
        spans.append({"word": start, "n_words": n, "label": label})
        if phrase in BASE:
            base.add(label)
            out["n_base"] += 1
            out["first_word"] = start if out["first_word"] is None else min(start, out["first_word"])
            out["last_word"] = start if out["last_word"] is None else max(start, out["last_word"])
        strictest = max(strictest, 0.5 + DUTY[LABELS[label]] / 20)
    if any(phrase == TAG for _, (phrase, _) in hits):
        for given in _TAG_LINE.findall(raw):
            given = re.split(r"\*/|-->|#", given)[0].strip()
            try:
                value, names = evaluate(given)
            except UnknownName:
                labels.add("spdx-unknown")
                continue
            except BadExpression:
                labels.add("spdx-invalid")
                continue
            labels.update(f"spdx:{x}" for x in names)
            expressions.append({"text": given, "duty": value})
            strictest = max(strictest, 0.75 + value / 20)
    return out | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": strictest, "expressions": expressions, "spans": spans}


SHAPE = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
    ("score", pa.float64()), ("expressions", pa.list_(pa.struct([("text", pa.string()), ("duty", pa.int32())]))),
    ("spans", pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int32()), ("label", pa.string())])))])
SCAN = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
        "expressions:array<struct<text:string,duty:int>>,spans:array<struct<word:bigint,n_words:int,label:string>>>")


def _scan_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    machine = automaton()
    for batch in batches:
        yield pa.array([scan(x.as_py(), machine) for x in batch], SHAPE)


def licences(text: Column) -> Column:
    """Scan of a text column; see :func:`license_scan`."""
    return F.arrow_udf(_scan_all, SCAN)(text)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices, tags and expressions of whole texts, one row per input row.

    ``id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, spans``

    * Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
      in lower case; a place is where a phrase's words stand one after another, and places
      may overlap. Word positions begin at 0.
    * ``labels`` holds base labels, labels of further notices, and ``spdx:`` with each licence
      of a valid expression; an expression that cannot be parsed gives ``spdx-invalid``, one with
      a name that is no identifier ``spdx-unknown``, and neither adds to the score.
    * The score is 0 without any finding, else grows with how far the strictest finding binds.
    * Texts and expressions of any length are read whole, in linear time.
    * Null and empty texts have no words and null positions. Repeated rows and null ids are
      scanned like others. Other columns are not read.
    """
    said = docs.select(F.col(id_col).alias("_id"), licences(F.col(text_col)).alias("_s"))
    return said.select(F.col("_id").alias(id_col), "_s.*")
