"""The pipeline's stages take effect one after another and keep clean documents."""

import re
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from contrail.llm.exact_dedup import exact_dedup
from contrail.session import stage


def test_stages(spark, tmp_path):
    text = lambda i, words: " ".join(f"{w}{chr(97 + (i * 7 + k * k) % 26)}" for k, w in enumerate(words.split() * 12))
    en, fr = "the house and of river with every day", "le maison et du fleuve avec chaque jour"
    rows = [(i, text(i, en if i % 2 else fr), "en" if i % 2 else "fr", f"s{i % 3}", 1) for i in range(24)]
    rows += [(100, "123 456", "en", "s0", 7), (101, None, None, None, None), (102, rows[3][1].replace(" ", "  "), "en", "s0", 1), (103, rows[4][1] + " more", "fr", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, step in P.STAGES:
        docs = stage(step(spark, docs, str(tmp_path)), name)
        seen[name] = docs
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    assert set(range(24)) <= set(ids["language_id"]) and not {100, 101} & set(ids["language_id"])
    assert ids["exact_dedup"] == [i for i in range(24) if i != 3] + [102, 103]  # the longer of equal texts stays
    assert 103 not in ids["ngram_jaccard_join"] and 4 in ids["ngram_jaccard_join"]
    kept, mix = seen["ngram_jaccard_join"], seen["mixing"]
    # texts are whole: a source misses its share of 150 % of all words by half a document at most
    size = lambda d: d.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    longest = max(len(r.text.split()) for r in kept.select("text").collect())
    assert abs(size(mix) - 1.5 * size(kept)) <= 3 * longest / 2 + 3 and mix.columns == kept.columns
    assert {r.text for r in mix.collect()} <= {r.text for r in kept.collect()}
    assert seen["sentencepiece"].where("not round_trip").count() == 0 and ids["sentencepiece"] == ids["mixing"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
FOX = " ".join(f"word{i}" for i in range(60))
SEA = " ".join(f"sea{i}" for i in range(70))


def staged(spark, rows, *steps):
    docs = stage(spark.createDataFrame(rows, COLUMNS), "docs")
    for step in steps:
        docs = stage(step(spark, docs, ""), "step")
    return docs


def test_rows_that_repeat_an_id(spark):
    row = lambda i, text: (i, text, "en", "s", len(text))
    # one row ten times; id 5 with two texts, of which FOX's copy loses against the longer one of 4
    rows = [row(1, SEA)] * 10 + [row(4, FOX + "  "), row(5, FOX), row(5, "other text " + SEA[::-1])]
    once = [row(1, SEA), row(4, FOX + "  "), row(5, "other text " + SEA[::-1])]
    marked = exact_dedup(spark.createDataFrame(rows, COLUMNS)).where("kept").collect()
    assert sorted(r.doc_id for r in marked) == [1, 4, 5]
    exact = staged(spark, rows, P.without_copies)
    assert sorted(map(tuple, exact.collect())) == sorted(once)
    # near copies under one id: one of them stays, and the unrelated text of the same id, too
    near = staged(spark, once + [row(1, SEA + " end"), row(1, SEA + " end"), row(4, "far away " + FOX[::-1])], P.without_near_copies)
    assert sorted(r.text[:4] for r in near.collect()) == sorted(["sea0", "word", "othe", "far "])
    # the mix takes rows, not ids: 1.5 times the words, no text more than twice
    mix = staged(spark, [row(7, FOX)] * 6 + [row(7, SEA)] * 6, P.mixed)
    words = [re.findall(r"\S+", r.text) for r in mix.collect()]
    assert abs(sum(map(len, words)) - 1.5 * 6 * (60 + 70)) <= 70 / 2  # one source, whole texts
    assert all(n <= 12 for n in Counter(w[0] for w in words).values())
    assert all(r.n_chars == len(r.text) for r in mix.collect())


def test_rows_without_an_id(spark):
    row = lambda i, text: (i, text, "en", "s", len(text))
    # alone; the longest copy of 2; a null id loses a tie; null ids only
    rows = [row(None, SEA), row(None, FOX + "  "), row(2, FOX), row(None, "tie here"), row(3, "tie here"), row(None, "a b c"), row(None, "a b c")]
    exact = staged(spark, rows, P.without_copies)
    assert sorted(map(str, exact.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[1], rows[4], rows[5]], COLUMNS).collect()))
    near = staged(spark, [row(None, SEA), row(9, SEA + " end"), row(None, FOX), row(None, FOX + " end")], P.without_near_copies).collect()
    assert sorted((r.doc_id is None, r.text[:4]) for r in near) == [(False, "sea0"), (True, "word")]
    mix = staged(spark, [row(None, FOX), row(None, SEA), row(1, "more " + FOX)], P.mixed).collect()
    assert abs(sum(len(r.text.split()) for r in mix) - 1.5 * (60 + 70 + 61)) <= 70 / 2 and any(r.doc_id is None for r in mix)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(40)
    lost = stage(docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))), "docs")
    assert P.known_language(spark, lost, "").where("doc_id is null").count() > 0
    assert P.tokens(spark, lost, "").where("doc_id is null").count() == lost.where("doc_id is null").count() > 0


def test_columns_that_bear_helpers_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(30)
    extra = {c: F.concat(F.lit(c), F.col("doc_id")) for c in ("_said", "_ROW", "_row_", "_size", "_taken", "_epoch", "_text", "component_id", "name", "row")}
    docs = stage(docs.withColumns(extra), "docs")
    for _, step in P.STAGES[:-1]:
        out = stage(step(spark, docs, ""), "step")
        assert out.columns == docs.columns
        assert out.count() > 0 and all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in extra)
        docs = out


def test_texts_of_the_mix_are_whole(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(7)), "en", "s", 1) for i in range(401)]
    texts = [r.text for r in staged(spark, rows, P.mixed).collect()]
    assert set(texts) <= {r[1] for r in rows} and abs(sum(len(t.split()) for t in texts) - 1.5 * 7 * 401) <= 4


def test_rows_are_named_by_their_place_in_files(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("_ROW"), F.lit("x").alias("_metadata"))
    docs.repartition(7).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    rows, row = P._numbered(read)
    names = {r.doc_id: r[row] for r in rows.collect()}
    assert row not in read.columns and len(set(names.values())) == 3000
    # the same names however the files are split and whatever is read of them
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        again, row = P._numbered(spark.read.parquet(str(tmp_path / "d")).where("doc_id % 3 = 1"))
        assert {r.doc_id: r[row] for r in again.collect()} == {i: n for i, n in names.items() if i % 3 == 1}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_huge_document_is_whole_or_absent(spark):
    rows = [(0, " ".join(["w"] * 5000), "en", "s", 1)] + [(i, f"a{i} b c", "en", "s", 1) for i in range(1, 50)]
    texts = Counter(r.text for r in staged(spark, rows, P.mixed).collect())
    assert set(texts) <= {r[1] for r in rows} and max(texts.values()) <= 2


def test_empty_tables_pass_every_stage(spark):
    docs = stage(spark.createDataFrame([], COLUMNS), "none")
    for _, step in P.STAGES:
        docs = stage(step(spark, docs, ""), "step")
        assert docs.count() == 0
