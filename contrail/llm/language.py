"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled text. A text is cut
into blocks, every block is compressed with every dictionary, and the language with the
fewest bytes wins; a narrow margin over the second is a rejection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A dictionary is made of at most so many blocks of a language's texts, of at most so many code points each.
SAMPLE_BLOCKS = 400
SAMPLE_CHARS = 1000
#: Bytes of a block: long ones would be compressed by their own beginning.
BLOCK = 2048
LEVEL = 3
#: A margin, as a share of the second-best size, below this is a rejection.
MARGIN = 0.002
UNKNOWN = "und"
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
ANSWER = "struct<lang:string,score:double,margin:double,rejected:boolean>"


def dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """One dictionary per language of the labelled rows.

    Whole texts are cut into blocks of SAMPLE_CHARS, and of each language the SAMPLE_BLOCKS blocks
    with the smallest hash of id, text and place are taken, wherever they stand: at most 400,000
    code points a language reach the driver. Rows with a null language or text are left out.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("_lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"),
        F.ceil(F.length(text_col) / SAMPLE_CHARS).cast("int").alias("_n"))
    # A threshold of the hash leaves about four times the sample, whatever the number of rows and tasks.
    many = {r["_lang"]: min(1.0, 4 * SAMPLE_BLOCKS / r["n"]) for r in rows.groupBy("_lang").agg(F.sum("_n").alias("n")).collect()}
    if not many:
        return {}
    share = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])[F.col("_lang")]
    low = lambda k: F.pmod(F.xxhash64(F.col("_row"), k), F.lit(1 << 32))
    picked = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: low(k) < F.col("_share") * float(1 << 32))
    rows = rows.withColumn("_share", share).withColumn("_block", F.explode(picked)).withColumn("_h", F.xxhash64("_row", "_block"))
    rows = rows.select("_lang", "_h", F.substring(F.col("_text"), F.col("_block") * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)).alias("_text"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text"))
    kept = rows.withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_BLOCKS).orderBy("_lang", F.desc("_rank")).collect()
    books: dict[str, list[str]] = {}
    for row in kept:
        books.setdefault(row._lang, []).append(row._text)
    return {lang: b" ".join(map(_plain, texts)) for lang, texts in books.items()}


def _plain(text: str) -> bytes:
    """Letters in lower case, words apart by one space; characters beyond ASCII stay."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())


def _packer(book: bytes, level: int) -> Callable[[bytes], bytes]:
    data = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def _classify(batches: Iterator[pa.Array], books: dict[str, bytes], margin: float) -> Iterator[pa.Array]:
    langs = sorted(books)
    vocabularies = [set(books[lang].split()) for lang in langs]
    packers = [_packer(books[lang], LEVEL) for lang in langs]
    for batch in batches:
        out = []
        for text in batch:
            raw = text.as_py()
            if raw is None or not langs or not any(map(str.isalpha, raw)):
                out.append({"lang": UNKNOWN, "score": 0.0, "margin": 0.0, "rejected": True})
                continue
            data = memoryview(_plain(raw))
            blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
            sizes = [sum(len(pack(b)) for b in blocks) for pack in packers]
            least = min(sizes)
            close = [i for i in range(len(langs)) if sizes[i] == least]
            if len(close) > 1:  # as happens to texts of a few words: whole words that the dictionaries hold decide
                own = set(bytes(data).split())
                held = {i: sum(len(w) for w in own if w in vocabularies[i]) for i in close}
                order = sorted(close, key=lambda i: (-held[i], -len(books[langs[i]]), langs[i]))
                gap = (held[order[0]] - held[order[1]]) / max(1, sum(map(len, own)))
            else:
                order = close
                second = min(sizes[:close[0]] + sizes[close[0] + 1:], default=0)
                gap = (second - least) / second if second else 1.0
            best = order[0]
            out.append({"lang": langs[best], "score": gap / (gap + margin) if gap else 0.0, "margin": gap, "rejected": gap < margin})
        yield pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]))


def language(text: Column, books: dict[str, bytes], margin: float = MARGIN) -> Column:
    """``struct<lang, score, margin, rejected>`` of a text column.

    * Null texts, texts without a letter, and any text when no language was learned: ``und``,
      score 0, rejected.
    * The whole text counts, whatever its length, in blocks, as lower-case words with one space between. Of
      equal sizes, which texts too short for a match have, the language whose dictionary holds more of
      the text's words wins, with that lead for a margin; then the one with the larger dictionary and
      the first by name, with score 0 and rejected.
    * The score grows with the margin, and is one half at the rejection threshold.

    The dictionaries, whose size the sample bounds, are broadcast.
    """
    held = SparkSession.active().sparkContext.broadcast(books)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _classify(batches, held.value, margin)

    return F.arrow_udf(run, ANSWER)(text)


def held_out(id_col: Column) -> Column:
    """True for a quarter of the ids, which training must not see; a null id counts as an empty one."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, books: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``id, held_out, lang_pred, score, margin, rejected``, one row per input row."""
    said = docs.select(F.col(id_col).alias("_id"), language(F.col(text_col), books, margin).alias("_a"))
    return said.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_a.lang").alias("lang_pred"),
                       F.col("_a.score").alias("score"), F.col("_a.margin").alias("margin"), F.col("_a.rejected").alias("rejected"))
