"""Language identification by compression.

For each language the texts of a bounded sample, whole, are the content of a raw-content zstandard dictionary. A text
is compressed, whole and chunk by chunk, with each dictionary; the language whose dictionary gives the fewest
bytes wins. Texts and dictionaries are reduced to lower-case words with runs of one word collapsed, so capitals,
symbols and padding do not count. Where the runner-up comes within `MARGIN` of the winner, a slower level that
finds shorter matches is asked, and where it is as close the decision is marked as rejected. The sample is the only
thing gathered: `PARTS * PER_PART` texts of a language, of at most `LANGUAGES` languages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import id_crc, table

#: Bounds of the training sample: parts of a language, and texts of a part; languages beyond which learning is refused.
PARTS, PER_PART = 16, 8
#: Bytes above which a text is sampled only where its part of a language has no shorter ones.
LONG = 1 << 20
#: Bytes of a text that are compressed together.
CHUNK = 4096
LEVEL, FINE_LEVEL, MARGIN = 6, 17, 0.01

WORD = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case words of letters, a word that follows itself once."""
    words = WORD.findall(text.lower())
    return " ".join([w for w, before in zip(words, [None, *words]) if w != before]).encode()


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """language -> dictionary content, the most frequent language first, from a sample of training texts.

    A language's rows fall into `PARTS` parts by a hash of id and text, and of each part the `PER_PART` rows with the
    smallest hashes are taken, texts over `LONG` bytes last, so no task sees a whole language; only then are their texts read. Rows equal in id and
    text count once. There are as many dictionaries as languages.
    """
    from pyspark.sql import Window as W

    rows = docs.where(train & F.col(lang_col).isNotNull() & (F.length(F.trim(F.col(text_col))) > 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("lang"), F.col(id_col), F.col(text_col)).alias("h"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row a language
    rank = F.row_number().over(W.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("long", "h"))
    picked = rows.select("lang", "h", (F.octet_length("text") > LONG).alias("long")).distinct().withColumn("r", rank).where(F.col("r") <= PER_PART).select("lang", "h")
    # at most PARTS * PER_PART rows of two values for each language
    texts = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.max("text").alias("text")).collect()
    out: dict[str, bytes] = {r["lang"]: b"" for r in common}
    for r in sorted(texts):
        out[r["lang"]] += plain(r["text"]) + b"\n"
    return {lang: content for lang, content in out.items() if content.strip()}


class Classifier:
    """Compressors of each language, at two levels."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.quick, self.fine = ([self.packer(content[lang], level) for lang in self.langs] for level in (LEVEL, FINE_LEVEL))

    @staticmethod
    def packer(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def nearest(self, text: bytes, packers: list) -> tuple[int, float]:
        """The language that packs the whole text smallest, and by what share of its bytes the next one is larger."""
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        sizes = [sum(len(p.compress(c)) for c in chunks) for p in packers]
        best, *rest = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        return best, (sizes[rest[0]] - sizes[best]) / sizes[rest[0]] if rest else 1.0

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is 0.5 for a tie and nears 1 as the margin grows."""
        words = plain(text or "")
        if not self.langs or not words or not any(map(str.isalpha, text)):  # digits like ² are no letters
            return "und", 0.0, True
        best, margin = self.nearest(words, self.quick)
        if margin < MARGIN:
            best, margin = self.nearest(words, self.fine)
        return self.langs[best], 1 / (1 + math.exp(-60 * margin)), margin < MARGIN


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lang_pred, score, rejected) of every document.

    Defined cases: `und` with score 0 where the text is null, empty or has no letter, or nothing was learned;
    ties go to the language with more training texts; rows with equal ids are judged each by its own text;
    very long texts are compressed chunk by chunk to the end; an empty table gives an empty table.
    """
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(content)  # as large as the sample that `learn` bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            rows = [model(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc", "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, f"doc {src.schema['doc'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(3)) == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs, ~held_out(F.col("doc_id"))))
    return out.select(F.col("doc").alias("doc_id"), held_out(F.col("doc")).alias("held_out"), "lang_pred", "score", "rejected")
