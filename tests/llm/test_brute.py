"""Operators without SQL against plain versions, and every operator on very long texts."""

import random
import re

import numpy as np
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from contrail.llm import language as lg
from contrail.llm import licenses as lc
from contrail.llm import queries as Q
from contrail.llm import token_counts as tc
from contrail.llm.conversations import digests, repair
from contrail.llm.exact_dedup import exact_dedup
from contrail.llm.jaccard import near_duplicates
from contrail.llm.line_dedup import line_dedup
from contrail.llm.middle import fill_in_middle, restore
from contrail.llm.mixing import mix_sources
from contrail.llm.pieces import encode_documents, load
from contrail.llm.sharding import ring_shards


# --- token counts -----------------------------------------------------------

def attributed(encoder, text, cuts, rule):
    """Token counts of sections, character by character."""
    owner = {}
    for k, (a, b) in enumerate(cuts):
        owner |= dict.fromkeys(range(a, b), k)
    counts, outside, at, raw = [0] * len(cuts), 0, 0, text.encode()
    place = [i for i, c in enumerate(text) for _ in c.encode()]
    for token in encoder.encode_ordinary(text):
        size = len(encoder.decode_single_token_bytes(token))
        chars = sorted(set(place[at:at + size]))
        at += size
        own = [owner.get(c) for c in chars]
        if rule == "most":
            had = [own.count(k) for k in range(len(cuts))]
            k = had.index(max(had)) if any(had) else None
        else:
            k = own[0 if rule == "first" else -1]
        if k is None:
            outside += 1
        else:
            counts[k] += 1
    assert at == len(raw)
    return counts, outside


@pytest.mark.parametrize("rule", tc.RULES)
def test_token_counts_by_hand(spark, rule):
    vocabulary, pick = tc.ranks(Q.RANKS), random.Random(9)
    encoder = tiktoken.Encoding("r", pat_str=tc.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    rows, expected = [], {}
    for i in range(60):
        text = "".join(pick.choice(["hello", " world", "é", "日本", "😀", " ", "\n", "12", ".", "'s", "ing"]) for _ in range(pick.randint(0, 25)))
        borders = sorted(pick.sample(range(len(text) + 1), min(len(text) + 1, 6)))
        cuts = [(a, b) for a, b in zip(borders[::2], borders[1::2])]  # disjoint, with gaps
        rows.append((i, text, [c for c in reversed(cuts)]))
        expected[i] = attributed(encoder, text, cuts, rule)
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts array<struct<start:int,end:int>>")
    got = {}
    for r in tc.count_tokens(docs, vocabulary, F.col("text"), F.col("cuts"), rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, (counts, outside) in expected.items():
        own = sorted((r for r in got[i] if r.section is not None), key=lambda r: r.start)
        assert [r.n_tokens for r in own] == counts and got[i][0].outside == outside, rows[i]


def test_long_white_space_is_encoded_as_the_pattern_says(monkeypatch):
    vocabulary, pick = tc.ranks(Q.RANKS), random.Random(10)
    encoder = tiktoken.Encoding("r", pat_str=tc.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    monkeypatch.setattr(tc, "LONG_RUN", 3)
    for _ in range(3000):
        text = "".join(pick.choice([" ", " ", "  ", "\n", "\t", "\x85", " ", "　", "\x1c", "\xa0", "a", "B", "7", ".", "é", "'s", "日"]) for _ in range(pick.randint(0, 14)))
        assert tc.encoded(encoder, text) == encoder.encode_ordinary(text), repr(text)


# --- licences ---------------------------------------------------------------

def places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for phrase, label in lc.BASE.items() for i in range(len(words)) if words[i:i + phrase.count(" ") + 1] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def test_licence_places_by_hand(spark):
    pick = random.Random(12)
    parts = "gnu GENERAL general public license License. Apache cc by, mit MIT- é 日 cc\x00by gnu's x7 \n".split(" ")
    rows = [(i, pick.choice([None, " ".join(pick.choice(parts) for _ in range(pick.randint(0, 30)))])) for i in range(400)] + [(None, "MIT license"), (3, "mit license " * 3), (3, "mit license " * 3)]
    got = lc.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((i, *places(t))) for i, t in rows)


def test_licence_names_are_whole():
    free = lambda x: lc.evaluate(x)[0]
    assert (free("MIT"), free("GPL-2.0+"), free("LicenseRef-own"), free("gpl-2.0-only with classpath-exception-2.0"), free("CC-BY-NC-4.0")) == (1, 3, 5, 2, 4)
    for bad in ("MITRE-internal", "foo-bar", "MIT-internal", "Classpath-exception-2.0", "GPL-2.0-only OR foo"):
        with pytest.raises(lc.UnknownName):
            lc.evaluate(bad)
    for bad in ("MIT WITH (GPL-2.0 OR MIT)", "MIT WITH Apache-2.0", "(MIT OR ISC) WITH LLVM-exception", "MIT WITH", "WITH LLVM-exception"):
        with pytest.raises(lc.BadExpression):
            lc.evaluate(bad)
    machine = lc.automaton()
    assert lc.scan("SPDX-License-Identifier: foo-bar", machine)["labels"] == "spdx-unknown" and lc.scan("SPDX-License-Identifier: foo-bar", machine)["score"] == 0
    many = " OR ".join(["MIT"] * 100_000)  # in linear time
    assert lc.scan(f"SPDX-License-Identifier: {many}\n", machine)["labels"] == "spdx:mit"


# --- languages --------------------------------------------------------------

def test_languages_against_plain_compression(spark, sf):
    books = lg.dictionaries(spark.read.parquet(f"{sf}/documents.parquet").where(~lg.held_out(F.col("doc_id"))))
    sizes = {}
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r.text]
    pack = {}
    for name, book in books.items():
        d = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        pack[name] = zstandard.ZstdCompressor(level=lg.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in rows:
        plain = " ".join(re.findall(r"[a-z\x80-\U0010ffff]+", r.text.lower())).encode()
        sizes[r.doc_id] = {n: sum(len(p.compress(plain[i:i + lg.BLOCK])) for i in range(0, len(plain), lg.BLOCK)) for n, p in pack.items()}
    got = {r.doc_id: r for r in lg.identify(spark.createDataFrame(rows), books).collect()}
    for i, own in sizes.items():
        ranked = sorted(own.values())
        if got[i].lang_pred == lg.UNKNOWN:
            assert not any(map(str.isalpha, next(r.text for r in rows if r.doc_id == i)))
        else:
            assert own[got[i].lang_pred] == ranked[0]
            if ranked[0] < ranked[1]:
                assert got[i].margin == pytest.approx((ranked[1] - ranked[0]) / ranked[1]) and got[i].rejected == (got[i].margin < lg.MARGIN)


def test_language_ties_repeats_and_whole_texts(spark):
    books = {"aa": b"same words here", "bb": b"same words here"}
    rows = [(1, "same words"), (1, "same words"), (None, "same words"), (2, None)]
    got = lg.identify(spark.createDataFrame(rows, "doc_id long, text string"), books).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got] == [("aa", 0.0, True)] * 3 + [("und", 0.0, True)]
    # blocks come from all of a text: its end, too, is learned
    text = "".join(f"{chr(97 + k % 26) * 9} " for k in range(40_000))
    learned = lg.dictionaries(spark.createDataFrame([(1, text + "finally " * 200_000, "xx")], "doc_id long, text string, lang string"))
    assert b"finally" in learned["xx"] and b"aaaa" in learned["xx"] and len(learned["xx"]) <= lg.SAMPLE_BLOCKS * (lg.SAMPLE_CHARS + 1)


# --- near copies ------------------------------------------------------------

def test_near_copies_about_the_threshold(spark):
    pick, texts = random.Random(21), []
    for _ in range(45):  # families whose members are some edits apart
        n = pick.choice([5, 6, 9, 20, 40, 66, 90, 150, 300])
        base = [f"w{pick.randrange(5000)}" for _ in range(n)]
        for _ in range(5):
            own = list(base)
            for _ in range(pick.randint(0, max(1, n // 30))):
                own[pick.randrange(len(own))] = f"x{pick.randrange(10**6)}"
            cut = pick.randint(0, max(1, n // 8))
            texts.append(" ".join(own[cut:] if pick.random() < 0.5 else own[:len(own) - cut]))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root, links = list(range(len(texts))), 0

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                links += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert links > 60 and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), top(i)) for i, s in enumerate(sets)}


# --- very long texts ----------------------------------------------------------

def test_every_operator_on_very_long_texts(spark):
    letters = np.random.default_rng(3).integers(97, 123, 2_000_000, np.uint8).tobytes().decode()
    long = [" " * 5_000_000, "\n" * 1_000_000, "a" * 3_000_000, " x" * 700_000, letters, " ".join(letters[i:i + 6] for i in range(0, 1_200_000, 6))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*long, long[-1]])], "doc_id long, text string, lang string, source string").repartition(4)
    n = len(long) + 1
    assert tc.count_tokens(docs, tc.ranks(Q.RANKS), F.col("text")).select("doc_id").distinct().count() == n
    assert line_dedup(docs).count() == n
    assert [(r.doc_id, r.n_words) for r in lc.license_scan(docs).select("doc_id", "n_words").collect() if r.doc_id in (0, 2, 3)].__len__() == 3
    assert encode_documents(docs, load(Q.PIECES)).where("round_trip").count() == n
    mixed = mix_sources(docs).collect()
    assert len(mixed) == n and sum(r.taken for r in mixed) == int(mixed[0].target)
    assert lg.identify(docs, {"en": b"words of any kind"}).count() == n
    near = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert near == {i: i for i in range(n - 1)} | {n - 1: n - 2}
    assert {r.doc_id for r in exact_dedup(docs).where("kept").collect()} == {0, 2, 3, 4, 5}  # white space alone is empty
    made = fill_in_middle(docs)
    assert made.select("doc_id", restore(F.col("output"), F.col("form")).alias("text")).exceptAll(docs.select("doc_id", "text")).count() == 0
    assert ring_shards(docs, 3).select(F.sum("size")).first()[0] == sum(map(len, long)) + len(long[-1]) + 16 * n
    talk = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    done = repair(talk)
    assert done.summary.first()["blank"] == 2 and digests(done.rows).count() == 1
