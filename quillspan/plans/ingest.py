"""The ingest plan: documents to stored chunks, one narrow stage and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.extensions import ChunkEnricher, Embedder, HashingEmbedder, HeadingEnricher
from quillspan.functions.text import provenance_id
from quillspan.operators.headings import headings
from quillspan.operators.pages import pages_for_range
from quillspan.operators.splitter import recursive_chunks

#: Names and types of a stored chunk.
CHUNK_FIELDS = (
    ("document_id", T.StringType()), ("chunk_index", T.IntegerType()), ("filename", T.StringType()), ("upload_date", T.StringType()), ("text", T.StringType()),
    ("chunk_size", T.IntegerType()), ("document_type", T.StringType()), ("structured_fields", T.StringType()), ("source_start_byte", T.LongType()), ("source_end_byte", T.LongType()),
    ("page_start", T.IntegerType()), ("page_end", T.IntegerType()), ("provenance_id", T.StringType()), ("retrieval_text", T.StringType()), ("embedding", T.ArrayType(T.FloatType())),
)
CHUNK_SCHEMA = T.StructType([T.StructField(n, t) for n, t in CHUNK_FIELDS])


def ingest(documents: DataFrame, embedder: Embedder | None = None, enricher: ChunkEnricher | None = None) -> DataFrame:
    """documents (document_id, filename, upload_date, extension, sha256, text, and spans of pages or null) to chunks of
    CHUNK_SCHEMA. Only retrieval text that differs from the chunk is kept; it is what gets embedded."""
    embedder, enricher = embedder or HashingEmbedder(), enricher or HeadingEnricher()
    spans = F.col("spans") if "spans" in documents.columns else F.lit(None).cast("array<struct<page:int,start_byte:bigint,end_byte:bigint>>")
    own = documents.select(F.col("document_id").cast("string").alias("document_id"), "filename", "upload_date", "extension", "sha256", "text", headings(F.col("text")).alias("headings"), spans.alias("spans"))
    chunks = enricher.enrich(recursive_chunks(own, [c for c in own.columns if c not in ("text", "headings")], marks="headings"))
    pages = pages_for_range(F.col("spans"), F.col("start_byte"), F.col("end_byte"))
    return chunks.select(
        "document_id", "chunk_index", "filename", "upload_date", F.col("chunk").alias("text"), F.octet_length("chunk").alias("chunk_size"), F.col("extension").alias("document_type"),
        F.lit(None).cast("string").alias("structured_fields"), F.col("start_byte").alias("source_start_byte"), F.col("end_byte").alias("source_end_byte"),
        pages["first"].alias("page_start"), pages["last"].alias("page_end"), provenance_id(F.col("sha256"), F.col("chunk_index")).alias("provenance_id"),
        "retrieval_text", embedder.embed(F.coalesce("retrieval_text", "chunk")).alias("embedding"),
    )
