"""Extension points. Model steps are protocols; the defaults here are deterministic offline substitutes, not models."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators import headings, retrieval


class Embedder(Protocol):
    dimension: int

    def embed(self, text: Column) -> Column: ...


class Generator(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame: ...


class ChunkEnricher(Protocol):
    def enrich(self, chunks: DataFrame) -> DataFrame: ...


class RetrievalStrategy(Protocol):
    def retrieve(self, vectors: DataFrame, questions: DataFrame) -> DataFrame: ...


class Reranker(Protocol):
    def rerank(self, hits: DataFrame) -> DataFrame: ...


class QueryPlanner(Protocol):
    def route(self, questions: DataFrame) -> DataFrame: ...


class KnowledgeProvider(Protocol):
    def facts(self, questions: DataFrame) -> DataFrame | None: ...


class EvidenceLayer(Protocol):
    def verify(self, answers: DataFrame) -> DataFrame: ...


class HashingEmbedder:
    """Substitute for a model: words hashed to signed places, the sum at unit length. Blank text gives zeros."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, text: Column) -> Column:
        n = self.dimension

        @F.pandas_udf("array<float>")
        def run(column: pd.Series) -> pd.Series:
            import zlib

            out = []
            for t in column:
                v = np.zeros(n)
                for word in (t or "").lower().split():
                    h = zlib.crc32(word.encode())
                    v[h % n] += 1 if h & (1 << 31) else -1
                size = float(np.sqrt((v**2).sum()))
                out.append((v / size if size else v).astype(np.float32))
            return pd.Series(out)

        return run(text)


class ExtractiveGenerator:
    """Substitute for a model: the start of the first context block."""

    def __init__(self, length: int = 400):
        self.length = length

    def answer(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("answer", F.substring(F.split_part("context", F.lit("\n\n---\n\n"), F.lit(1)), 1, self.length))


class HeadingEnricher:
    def enrich(self, chunks: DataFrame) -> DataFrame:
        return headings.enriched(chunks)


class SemanticRetrieval:
    def __init__(self, k: int = retrieval.TOP_K, threshold: float | None = retrieval.THRESHOLD, key: str = "vec_id", vector: str = "embedding"):
        self.k, self.threshold, self.key, self.vector = k, threshold, key, vector

    def retrieve(self, vectors: DataFrame, questions: DataFrame) -> DataFrame:
        return retrieval.top_k_batch(vectors, questions, self.k, self.threshold, self.key, self.vector)


class NoReranking:
    def rerank(self, hits: DataFrame) -> DataFrame:
        return hits


class AlwaysSemantic:
    def route(self, questions: DataFrame) -> DataFrame:
        return questions.withColumn("route", F.lit("semantic"))


class NoKnowledge:
    def facts(self, questions: DataFrame) -> None:
        return None


class NoEvidence:
    def verify(self, answers: DataFrame) -> DataFrame:
        return answers.withColumn("verified", F.lit(False))
