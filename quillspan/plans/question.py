"""The question plan: questions to hits, sources, context, history, prompts and answers, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.extensions import AlwaysSemantic, Embedder, EvidenceLayer, ExtractiveGenerator, Generator, HashingEmbedder, KnowledgeProvider, NoEvidence, NoKnowledge, NoReranking, QueryPlanner, Reranker, RetrievalStrategy, SemanticRetrieval
from quillspan.operators import prompt, retrieval

SOURCE_FIELDS = ("document_id", "filename", "chunk_index", "text", "similarity", "page_start", "page_end", "source_start_byte", "source_end_byte", "provenance_id")


def source(similarity: Column) -> Column:
    """The API's view of a hit."""
    return F.struct(*(similarity.alias(f) if f == "similarity" else F.col(f) for f in SOURCE_FIELDS))


def sources_json(sources: Column) -> Column:
    return F.to_json(sources)


def sources_from_json(text: Column, ddl: str) -> Column:
    """The array back from JSON; empty where it can't be read."""
    return F.coalesce(F.from_json(text, ddl), F.array().cast(ddl))


def ask(questions: DataFrame, chunks: DataFrame, messages: DataFrame | None = None, embedder: Embedder | None = None, generator: Generator | None = None, reranker: Reranker | None = None, k: int = retrieval.TOP_K, threshold: float | None = retrieval.THRESHOLD, planner: QueryPlanner | None = None, strategy: RetrievalStrategy | None = None, knowledge: KnowledgeProvider | None = None, evidence: EvidenceLayer | None = None) -> DataFrame:
    """questions (query_id, question, and conversation where messages are given) with route, sources, context, prompt,
    answer and verified. messages: conversation, id, role, text; the question itself isn't among them yet. Facts of the
    knowledge provider (query_id, structured) fill the prompt's structured slot."""
    embedder, generator, reranker = embedder or HashingEmbedder(), generator or ExtractiveGenerator(), reranker or NoReranking()
    strategy = strategy or SemanticRetrieval(k, threshold)
    questions = (planner or AlwaysSemantic()).route(questions)
    keyed = chunks.withColumn("vec_id", F.xxhash64("provenance_id", "document_id"))
    asked = questions.withColumn("embedding", embedder.embed(F.col("question")))
    hits = reranker.rerank(strategy.retrieve(keyed, asked))
    full = hits.join(keyed.drop("embedding"), "vec_id")
    sources = F.array_sort(F.collect_list(F.struct("rank", source(F.col("similarity")).alias("s"))))
    listed = full.groupBy("query_id").agg(F.transform(sources, lambda x: x["s"]).alias("sources"))
    contexts = prompt.context_blocks(full.withColumn("context_text", prompt.context_text(F.col("text"), F.col("retrieval_text"))), ["query_id"])
    out = questions.join(listed, "query_id", "left").join(contexts, "query_id", "left")
    if messages is not None:
        out = out.join(prompt.histories(messages, "conversation", "id"), "conversation", "left")
    facts = (knowledge or NoKnowledge()).facts(questions)
    if facts is not None:
        out = out.join(facts.select("query_id", "structured"), "query_id", "left")
    slots = {"structured": F.coalesce("structured", F.lit("")) if facts is not None else F.lit(""), "history": F.col("history") if messages is not None else F.lit(""), "context": F.col("context"), "question": F.col("question")}
    out = out.withColumn("prompt", prompt.filled(prompt.TEMPLATE, slots))
    return (evidence or NoEvidence()).verify(generator.answer(out))
