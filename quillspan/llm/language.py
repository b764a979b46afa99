"""Language identification by compression.

Each language gets a zstandard raw-content dictionary of stretches of learned texts, drawn by hash from the whole of
each text. A text is cut into blocks of BLOCK bytes, each block is compressed under every dictionary, and the language
with the smallest total wins. Where the winner's margin is narrow the row is marked `rejected`; lang_pred still names
the best language.

Defined results: null text or text without a letter gives `und` with score 0, as does a corpus with nothing to
learn from; equal sizes go to the language that comes first by code point, as rejected; repeated rows are predicted
alike; columns of the names of the results give way to them, other extra columns are kept if asked for; an empty table
gives an empty result; a very long text is compressed whole, block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TEXT, arrow_of, documents, learnable

#: Learned texts per language at most, and bytes of a dictionary: documented bounds of the training sample.
SAMPLE_TEXTS = 480
DICTIONARY_BYTES = 96 * 1024
#: A language's keys are ranked in so many groups of scan tasks first, so that its one last task meets SALTS * SAMPLE_TEXTS
#: at most. The groups don't change which keys are picked.
SALTS = 16
#: Code points of a stretch. Learned texts are cut up whole, and each stretch has the same chance to be held.
STRETCH = 400
#: Blocks are compressed apart, so that a long text's own repeats don't outweigh the dictionaries.
BLOCK = 4096
LEVEL = 6
#: Relative margin under which a prediction is marked as rejected.
NARROW = 0.01

_LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> str:
    """Lower-case words of letters, joined by one space: case, digits and punctuation tell little of a language."""
    return " ".join(_LETTERS.findall(text.lower()))


def parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, window_log=17, source_size=BLOCK, dict_size=DICTIONARY_BYTES)


def fit(docs: DataFrame, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each non-null lang of the given rows: of the texts with the smallest hashes of their ids, the
    stretches with the smallest hashes, as many as it holds. Texts are ranked by their keys; only the picked ones move."""
    able = docs.select("lang", "doc_id", "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    able = able.withColumn("h", F.xxhash64("text"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(4)), "doc_id", "h"
    picked = able.select("lang", "doc_id", "h", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    for own in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*own).orderBy(*order))
        picked = picked.withColumn("r", rank).where(F.col("r") <= SAMPLE_TEXTS).drop("r")
    picked = picked.alias("p")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("lang", "doc_id", "h")]
    rows = able.alias("a").join(F.broadcast(picked), same, "left_semi")  # SAMPLE_TEXTS keys a language
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(STRETCH))
    cut = rows.select("lang", F.explode(F.transform(starts, lambda i: F.substring("text", i, F.lit(STRETCH)))).alias("stretch")).distinct()
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("stretch", F.lit(4)), "stretch")
    before = F.coalesce(F.sum(F.octet_length("stretch")).over(by_hash.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = cut.withColumn("place", F.row_number().over(by_hash)).withColumn("before", before).where(F.col("before") < size)
    texts: dict[str, list[str]] = {}
    for r in held.select("lang", "stretch").orderBy("lang", "place").toLocalIterator():  # about `size` bytes a language
        texts.setdefault(r.lang, []).append(r.stretch)
    return {lang: dictionary(some, size) for lang, some in texts.items()}


def dictionary(stretches: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """The stretches one after another, at most so many bytes."""
    return b" ".join(plain(s).encode() for s in stretches)[:size]


class Judge:
    """Compressed sizes of a text under every language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.packers = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=parameters())
            self.packers.append(zstandard.ZstdCompressor(compression_params=parameters(), dict_data=content))

    def sizes(self, raw: bytes) -> np.ndarray:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return np.array([sum(len(p.compress(b)) for b in blocks) for p in self.packers], np.int64)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected)."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = plain(text).encode()
        sizes = self.sizes(raw)
        order = np.argsort(sizes, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0, False
        best, second = int(sizes[order[0]]), int(sizes[order[1]])
        margin = (second - best) / max(second, 1)
        score = 1.0 - 1.0 / (1.0 + np.exp(min(60.0, 0.5 * (second - best) + 20 * margin)))
        return self.langs[order[0]], float(score), bool(margin < NARROW)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with lang_pred, score and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICTIONARY_BYTES for each language
    schema = arrow_of(docs, keep, "lang_pred string, score double, rejected boolean")
    keep = schema.names[:-3]
    cols = docs.select(*keep, F.col(text).alias(TEXT))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Judge(sent.value)
        for batch in batches:
            said = [model.predict(t.as_py()) for t in batch.column(len(keep))]
            out = [batch.column(i) for i in range(len(keep))]
            out += [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([s[2] for s in said], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, [*keep, "lang_pred", "score", "rejected"])

    return cols.mapInArrow(judge, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(learnable("doc_id")))
    out = identify(docs, model, ["doc_id"])
    return out.select("doc_id", (~learnable("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
