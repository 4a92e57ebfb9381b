"""A training corpus from raw documents: five stages, each a written table.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what it
keeps of ``docs``. All but the last return the columns of documents. Rows with a null doc_id are
documents like others, kept or dropped by their texts; where ids decide, they come last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrail.llm.common import BYTES_AT_ONCE, ROWS_AT_ONCE
from contrail.llm.exact_dedup import exact_dedup
from contrail.llm.jaccard import near_duplicates
from contrail.llm.language import dictionaries, held_out, language
from contrail.llm.mixing import mix_sources
from contrail.llm.pieces import encode_documents, load
from contrail.llm.queries import PIECES
from contrail.session import stage

#: Names of input files are held by every executor up to so many bytes of them.
FILE_NAMES = 32 << 20
#: The row of a file that a number can name.
FILE_BITS = 40


def _bounded(spark: SparkSession) -> None:
    """Executors hold a JVM and two Python workers: rows of whole texts go between them in small batches."""
    spark.conf.set(ROWS_AT_ONCE, 1000)
    spark.conf.set(BYTES_AT_ONCE, "8m")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; the dictionaries come from this stage's own
    documents, of those with an id."""
    _bounded(spark)
    books = dictionaries(docs.where(~held_out(F.col("doc_id"))))
    said = _free(docs, "_said")
    return docs.withColumn(said, language(F.col("text"), books)).where(~F.col(f"{said}.rejected")).drop(said)


def _free(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as keep it apart from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with unique row numbers, the same whenever it is read, and their column's name: operators decide
    about rows, and the decision finds its row again whatever ids repeat or miss.

    A row of a file is named by the file's number, in the order of their names, and its place there, which the
    reader knows: nothing is written again. Tables that are no files, or of more files than ``FILE_NAMES``
    allows to hand round, are written once with numbers."""
    row, path, files = _free(docs, "_row"), _free(docs, "_path"), None
    try:
        read = docs.withColumns({path: docs.metadataColumn("_metadata")["file_path"], row: docs.metadataColumn("_metadata")["row_index"]})
        files = read.groupBy(path).agg(F.count(F.lit(1)).alias("n")).drop("n")
        bounded = (files.agg(F.sum(F.length(path))).first()[0] or 0) <= FILE_NAMES
    except AnalysisException:  # no files
        bounded = False
    if not bounded:
        return stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row
    number = _free(docs, "_file")
    files = stage(files.withColumn(number, F.row_number().over(Window.orderBy(path)).cast("long")), "files")
    named = read.join(F.broadcast(files), path)
    return named.withColumn(row, F.shiftleft(number, FILE_BITS) + F.col(row)).drop(path, number), row


def _named(row: str) -> Column:
    """A name for each row, in the order of the ids, nulls last, then of the row numbers."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then the smallest id (null last), then the
    first row. A group whose ids are all null keeps a row, too."""
    _bounded(spark)
    rows, row = _numbered(docs)
    kept = exact_dedup(rows.select(_named(row).alias("name"), "text"), "name").where("kept").select(F.col("name.row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the smallest id (null last), then the first row.
    Components are found among rows, so rows that repeat an id, or have none, meet only through their texts."""
    _bounded(spark)
    rows, row = _numbered(docs)
    found = near_duplicates(rows, row).select(row, "component_id").join(rows.select(row, "doc_id"), row)
    kept = found.groupBy("component_id").agg(F.min(_named(row)).alias("name")).select(F.col("name.row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of a document as the mix takes epochs of it, always its whole text. The document inside which
    a source's budget ends is taken whole if half of it or more fits, else left: so a source's words miss its
    target by half of that document at most. Rows that repeat an id are taken row by row; rows without an id
    draw one key together, and are taken row by row, too."""
    numbered, row = _numbered(docs)
    times, epoch = _free(docs, "_times"), _free(docs, "_epoch")
    plan = mix_sources(numbered, row_col=row).where("size > 0")
    plan = plan.select(row, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    rows = numbered.join(plan, row).withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    """Piece numbers of every row of the mix, checked by decoding."""
    _bounded(spark)
    return encode_documents(docs, load(model_path))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", tokens),
]

#: No SQL says these stages; tests hold them against brute force, language ID also against held-out labels and the
#: pieces against the library that defines them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
