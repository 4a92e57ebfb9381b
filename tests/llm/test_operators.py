"""Training-data operators against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from contrail.llm import mixing
from contrail.llm import queries as Q
from contrail.llm import token_counts as tc
from contrail.llm.exact_dedup import exact_dedup
from contrail.llm.jaccard import near_duplicates
from contrail.llm.language import dictionaries, identify
from contrail.llm.licenses import BadExpression, evaluate, license_scan
from contrail.llm.line_dedup import line_dedup
from contrail.llm.mixing import mix_sources
from contrail.llm.pieces import Transducer, encode_documents, load
from contrail.llm.topk import block_topk, topk
from contrail.llm.url_filter import url_verdicts

DOCS = "doc_id long, text string, lang string, source string, _id string, size int, _key int"
WORDS = "alpha beta gamma delta omega sigma theta kappa lambda zeta".split()


def rows():
    random.seed(3)
    long = " ".join(random.choice(WORDS) + str(random.randint(0, 99)) for _ in range(3000))
    base = " ".join(random.choice(WORDS) + str(i) for i in range(90))
    texts = [None, "", " \n\t", "one", long, long + " end", base, base, base.upper(), base.replace("5", "x", 1), base + " tail more", "a  b\nc", "a b c", "shared line of text\nown one",
             "Shared line of text \nother", "Gnu general Public license, MIT license", "été über 日本 \x00 ﬀ", "n o p q r", "n o p q r s"]
    out = [(i, t, "en" if i % 2 else None, [None, "a", "b"][i % 3], "x", 1, 2) for i, t in enumerate(texts)]
    return out + [out[7], out[13], (None, "shared line of text", "en", None, "x", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    model, ranks = load(Q.PIECES), tc.ranks(Q.RANKS)
    for out in (line_dedup(none), exact_dedup(none), mix_sources(none), near_duplicates(none), license_scan(none), encode_documents(none, model),
                tc.count_tokens(none, ranks, F.col("text")), identify(none, dictionaries(none))):
        assert out.count() == 0


def test_line_dedup(docs):
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs).collect()}
    assert (13, "shared line of text\nown one", 2, 0) in got and (14, "other", 2, 1) in got and (None, "", 1, 1) in got and (0, "", 1, 0) in got
    assert line_dedup(docs).count() == len(rows())


def test_exact_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in rows():
        groups.setdefault(norm(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] if r[0] is not None else 0))
    got = exact_dedup(docs).collect()
    assert len(got) == len(rows())
    known = {r.text_sha256: (r.keep_id, r.group_size) for r in got}
    for text, group in groups.items():
        best = min(group)
        assert known[hashlib.sha256(text.encode()).hexdigest()] == (None if best[1] else best[2], len(group))


def test_near_duplicates(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low))
        if r[0] is not None:
            sets[r[0]] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])


def test_near_duplicates_of_one_id_with_two_texts(spark):
    fox, sea = (" ".join(f"{w}{i}" for i in range(80)) for w in ("fox", "sea"))
    rows = [(5, fox), (5, sea), (5, sea), (2, fox + " end"), (9, sea + " end"), (7, "own words of five and six")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the texts of 5 are in one component each, named by its smallest id
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (5, 2), (5, 5), (5, 5), (7, 7), (9, 5)]


def test_mixing(docs):
    got = mix_sources(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs).collect()))
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(int(target) == taken for target, taken in by.values())


def test_mixing_spreads_noise_and_repeated_ids(spark, monkeypatch):
    noisy = [(i if i % 2 else None, "a # # # # # # # # b" if i % 3 else "a b c", "s") for i in range(4000)]
    docs = spark.createDataFrame(noisy, "doc_id long, text string, source string")
    seen, written = {}, mixing.stage
    monkeypatch.setattr(mixing, "stage", lambda df, name: seen.setdefault(name, written(df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a table is one range
    try:
        got = mix_sources(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 4000 and sum(r.taken for r in got) == int(got[0].target)
    # the ranges follow each other in order, and none holds much more than its share, though null ids share two keys
    ranges = seen["mix-ranges"].groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")).orderBy("_range").collect()
    assert all(a.high <= b.low for a, b in zip(ranges, ranges[1:])) and len(ranges) > 1 and max(r.n for r in ranges) < 2000


def test_licences(spark):
    assert evaluate("MIT OR GPL-3.0-only AND Apache-2.0")[0] == 1 and evaluate("(MIT OR GPL-3.0-only) AND GPL-2.0-only WITH Classpath-exception-2.0")[0] == 2
    for bad in ("", "MIT OR", "(MIT", "MIT)", "AND MIT", "MIT Apache-2.0"):
        with pytest.raises(BadExpression):
            evaluate(bad)
    texts = [(1, "Apache License cc BY, mit-license."), (2, None), (3, "x\n// SPDX-License-Identifier: (MIT OR ISC)\ny"), (4, "SPDX-License-Identifier: MIT OR"), (5, "apachelicense apache licenses"),
             (6, "cc by cc by")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1].base_labels, got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == ("apache,cc-by,mit", 3, 0, 4, 6)
    assert (got[2].n_words, got[2].first_word, got[2].score) == (0, None, 0.0) and got[3].labels == "spdx:isc,spdx:mit" and got[4].labels == "spdx-invalid"
    assert got[5].n_base == 0 and (got[6].n_base, got[6].first_word, got[6].last_word) == (2, 0, 2)


def test_pieces(docs):
    model = load(Q.PIECES)
    mine, theirs = Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    random.seed(5)
    for _ in range(1500):
        text = "".join(random.choice("abcdehilnorst THE .,!?éß日😀\n\t0123") for _ in range(random.randint(0, 60)))
        assert mine.encode(text) == theirs.encode(text) and mine.decode(mine.encode(text)) == text
    for r in encode_documents(docs, model).collect():
        assert r.round_trip is not False and (r.tokens is not None or r.n_tokens == 0)


@pytest.mark.parametrize("rule", tc.RULES)
def test_token_counts(spark, docs, rule):
    ranks = tc.ranks(Q.RANKS)
    total = {}
    for r in tc.count_tokens(docs, ranks, F.col("text"), rule=rule).where("doc_id is not null").dropDuplicates(["doc_id", "section"]).collect():
        total.setdefault(r.doc_id, [r.doc_tokens, r.outside])[1] += r.n_tokens
    assert all(a == b for a, b in total.values())
    cut = spark.createDataFrame([(1, "hello world", [(0, 6), (6, 11)])], "doc_id long, text string, cuts array<struct<start:int,end:int>>")
    got = [r.n_tokens for r in tc.count_tokens(cut, ranks, F.col("text"), F.col("cuts"), rule=rule).orderBy("section").collect()]
    assert got == ([2, 0] if rule == "first" else [1, 1])  # " world" reaches over the border


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-300, 300, (400, 16))
    v[100:160] = v[3]  # ties
    got = block_topk(np.arange(400), v, np.arange(0, 400, 20), v[::20], 10)
    scores = v[::20] @ v.T
    for n, q in enumerate(range(0, 400, 20)):
        order = sorted((-s, i) for i, s in enumerate(scores[n]) if i != q)[:10]
        assert [(-s, i) for i, s in zip(got[1][got[0] == q], got[2][got[0] == q])] == [(s, i) for s, i in order]
    data = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (1, [0.5, 0.5]), (None, [1.0, 1.0]), (100, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk(df, df.where("vec_id % 100 = 0")).collect()] == [(0, 1, 1, 786432)]
    assert topk(df.where("false"), df.where("false")).count() == 0


def test_topk_of_repeated_rows(spark):
    one, low = [1.0, 0.5], [0.5, 0.25]
    # a row more than k + 1 times beside equal vectors of larger ids; the query's own row, too
    data = [(7, one)] * 15 + [(0, one)] * 15 + [(i, one) for i in (9, 11)] + [(i, low) for i in range(20, 32)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").coalesce(1)
    got = topk(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [7, 9, 11, *range(20, 27)] and [r["rank"] for r in got] == list(range(1, 11))
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (40, 8))
    ids, vectors = np.repeat(np.arange(40), 13), np.repeat(v, 13, axis=0)
    ids[:200] = 5  # an id with many vectors, each of them repeated, of which other ids have copies
    vectors[300:] = v[np.arange(220) % 9]
    for own in (5, 30):
        query = v[own:own + 1]
        _, found, scores = block_topk(ids, vectors, np.array([own]), query, 10)
        assert list(zip((-scores).tolist(), found.tolist())) == sorted({(-int(x @ query[0]), i) for x, i in zip(vectors, ids.tolist()) if i != own})[:10]


def test_urls(spark):
    urls = [(1, "http://A.example.com/en/7x?q"), (2, "https://example.com/en/1"), (3, None), (4, "no scheme"), (5, "http://notexample.net/de/8"), (6, "http://example.net/de/8#f"), (7, "x://com"), (1, "http://org/es/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = spark.createDataFrame(Q.RULES, "host string, path string, action string")
    got = {(r.page_id, r.rule, r.verdict) for r in url_verdicts(pages, rules).collect()}
    assert got == {(1, "example.com/en/7", "allow"), (2, "com/en/", "block"), (3, None, "allow"), (4, None, "allow"), (5, "net/de/", "allow"), (6, "example.net/de/8", "block"),
                   (7, None, "allow"), (1, "org/es/", "block")}
    assert url_verdicts(pages, rules.where("false")).where("verdict = 'block'").count() == 0 and url_verdicts(pages.where("false"), rules).count() == 0


def test_language(spark, sf):
    got = Q.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, "")], "doc_id long, text string")
    assert [r.lang_pred for r in identify(odd, {"en": b"the and"}).collect()] == ["und"] * 3
