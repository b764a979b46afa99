"""Prompts: context blocks, history, templates, and the cleaning of model text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: markers of the chat format
ROLE_START = r"<\|im_start\|>[^\n]*\n"
ROLE_END = r"<\|im_end\|>"
THOUGHT = r"(?s)<think>.*?</think>"
CONTEXT_GAP = "\n\n---\n\n"
HISTORY_HEAD = "CONVERSATION HISTORY:"
HISTORY_MESSAGES = 6
HISTORY_PAIRS = 3
HISTORY_LENGTH = 800

SLOTS = ("structured", "history", "context", "question")
TEMPLATE = "Answer from the excerpts alone and name the file of each fact.\n{structured}\n{history}\nEXCERPTS:\n{context}\n\nQUESTION: {question}\n"


def context_text(text: Column, retrieval_text: Column) -> Column:
    return F.coalesce(retrieval_text, text)


def context_blocks(hits: DataFrame, by: list[str], filename: str = "filename", text: str = "context_text", rank: str = "rank") -> DataFrame:
    """One row per question: n_sources and context, `[file]` and its text in rank order. Hits are at most k a question."""
    block = F.struct(rank, F.concat(F.lit("["), F.col(filename), F.lit("]\n"), F.col(text)).alias("block"))
    blocks = F.array_sort(F.collect_list(block))
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.transform(blocks, lambda b: b["block"]), CONTEXT_GAP).alias("context"))


def message_pairs(messages: DataFrame, conversation: str, order: str) -> DataFrame:
    """conversation, order, user, assistant: user messages that the assistant's next message answers."""
    w = Window.partitionBy(conversation).orderBy(order)
    ahead = messages.select(conversation, order, "role", F.col("text").alias("user"), F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("assistant"))
    return ahead.where((F.col("role") == "user") & (F.col("next") == "assistant")).select(conversation, order, "user", "assistant")


def last_messages(messages: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n messages of each group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return messages.withColumn("place", place).where(F.col("place") <= n).drop("place")


def history_text(pairs: Column) -> Column:
    """An array of struct<user,assistant> by time, as text: the last HISTORY_PAIRS, each message cut; empty for none."""
    last = F.slice(F.reverse(pairs), 1, HISTORY_PAIRS)
    cut = lambda x: F.substring(x, 1, HISTORY_LENGTH)
    lines = F.transform(F.reverse(last), lambda p: F.concat(F.lit("User: "), cut(p["user"]), F.lit("\nAssistant: "), cut(p["assistant"])))
    return F.when(F.size(pairs) > 0, F.concat(F.lit(HISTORY_HEAD + "\n"), F.array_join(lines, "\n"))).otherwise(F.lit(""))


def histories(messages: DataFrame, conversation: str, order: str, n: int = HISTORY_MESSAGES) -> DataFrame:
    """conversation, n_pairs, history of every conversation, from its last n messages."""
    recent = last_messages(messages, conversation, order, n)
    pairs = message_pairs(recent, conversation, order)
    grouped = pairs.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(order, "user", "assistant"))).alias("pairs"))
    every = messages.select(conversation).distinct().join(grouped, conversation, "left")
    pairs = F.coalesce("pairs", F.array().cast(grouped.schema["pairs"].dataType))
    return every.select(conversation, F.least(F.size(pairs), F.lit(HISTORY_PAIRS)).alias("n_pairs"), history_text(pairs).alias("history"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template's slots replaced one after another, in SLOTS' order: a slot's name inside an earlier value is
    replaced too."""
    out = F.lit(template)
    for slot in SLOTS:
        out = F.replace(out, F.lit("{" + slot + "}"), F.coalesce(values.get(slot, F.lit("")), F.lit("")))
    return out


def chat_wrapped(text: Column) -> Column:
    """User text without role markers, as a turn of the chat format with an empty thought. A role start that no
    newline follows stays."""
    clean = F.regexp_replace(text, ROLE_START + "|" + ROLE_END, "")
    return F.concat(F.lit("<|im_start|>user\n"), clean, F.lit("<|im_end|>\n<|im_start|>assistant\n<think>\n</think>\n"))


def without_thoughts(text: Column) -> Column:
    """Model text without closed thoughts, stripped; an unclosed one stays."""
    return F.regexp_replace(F.regexp_replace(text, THOUGHT, ""), r"(?U)^\s+|\s+$", "")


def answered(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Answers that say something; blank ones are errors and not kept."""
    return answers.where(F.regexp_replace(text, r"(?U)\s", "") != "")
