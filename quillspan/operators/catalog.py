"""The document and conversation catalogue: reads, writes as new states, listings and consistency checks.

A write takes the state before and returns the state after; saving it is the caller's single commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import strip

HISTORY_LIMIT = 100


# ---------------------------------------------------------------- documents


def active_documents(documents: DataFrame) -> DataFrame:
    return documents.where("is_deleted = 0").orderBy(F.desc("upload_date"), "id")


def all_documents(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("upload_date"), "id")


def document_by_id(documents: DataFrame, key) -> DataFrame:
    """Deleted ones too."""
    return documents.where(F.col("id") == F.lit(key))


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """stored with the new rows whose key it lacks; of equal new keys the least row, column by column."""
    fresh = new.select(*stored.columns).join(stored.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(F.struct(*stored.columns)).alias("__row"))
    return stored.unionByName(first.select("__row.*"))


def soft_deleted(documents: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Documents with is_deleted set for the keys of gone, and `affected`: whether that changed the row."""
    marked = documents.join(gone.select(key, F.lit(True).alias("__gone")).distinct(), key, "left")
    affected = F.coalesce("__gone", F.lit(False)) & (F.col("is_deleted") == 0)
    out = marked.withColumn("affected", affected)
    return out.withColumn("is_deleted", F.when(F.col("affected"), 1).otherwise(F.col("is_deleted"))).drop("__gone")


def documents_of_chunks(chunks: DataFrame) -> DataFrame:
    """document_id, filename, upload_date, n_chunks of every document in the vector store, newest first; chunks
    without a document are left out. Names come from the first chunk."""
    own = chunks.where(F.coalesce("document_id", F.lit("")) != "")
    first = lambda c: F.min_by(c, "chunk_index").alias(c)
    return own.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), first("filename"), first("upload_date")).orderBy(F.desc("upload_date"), "document_id")


def collection_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("points"), F.count_distinct("document_id").alias("documents"), F.sum("chunk_size").alias("bytes"))


def metadata_of_chunks(chunks: DataFrame, doc_type: Column, now: Column) -> DataFrame:
    """The documents' rows for chunks that have been stored: written after them, so that what a failure leaves are
    orphan vectors, which orphan_vectors() finds."""
    per = chunks.groupBy(F.col("document_id").alias("id"), "filename", doc_type.alias("doc_type")).agg(F.count(F.lit(1)).alias("chunk_count"))
    return per.select("id", "filename", now.alias("upload_date"), "doc_type", "chunk_count", F.lit(0).alias("is_deleted"))


# ---------------------------------------------------------------- consistency


def orphan_vectors(vector_documents: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Documents of the vector store without an active row."""
    return vector_documents.join(documents.where("is_deleted = 0").select(key), key, "left_anti")


def orphan_rows(vector_documents: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Active rows without vectors."""
    return documents.where("is_deleted = 0").join(vector_documents.select(key), key, "left_anti")


def sync_report(vector_documents: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """One row: active, deleted, orphan_vectors, orphan_rows, in_sync."""
    left = vector_documents.select(key).distinct().withColumn("in_vectors", F.lit(1))
    both = documents.select(key, "is_deleted").join(left, key, "full")
    active = F.coalesce(F.col("is_deleted") == 0, F.lit(False))
    indexed = F.col("in_vectors").isNotNull()
    out = both.agg(
        F.count_if(active).alias("active"),
        F.count_if(F.col("is_deleted") != 0).alias("deleted"),
        F.count_if(indexed & ~active).alias("orphan_vectors"),
        F.count_if(active & ~indexed).alias("orphan_rows"),
    )
    return out.withColumn("in_sync", (F.col("orphan_vectors") == 0) & (F.col("orphan_rows") == 0))


def already_uploaded(uploads: DataFrame, documents: DataFrame, on: list[str]) -> DataFrame:
    return uploads.join(documents.select(*on), on, "left_semi")


# ---------------------------------------------------------------- conversations and users


def conversations_of(conversations: DataFrame, user) -> DataFrame:
    return conversations.where(F.col("user_id") == F.lit(user)).orderBy(F.desc("updated_at"), "id")


def renamed(conversations: DataFrame, conversation: str, user, title: str, now: Column) -> DataFrame:
    """The user's conversation with a new title and time; a blank title changes nothing."""
    hit = (F.col("id") == conversation) & (F.col("user_id") == user) & F.lit(bool(title.strip()))
    return conversations.withColumn("title", F.when(hit, title.strip()).otherwise(F.col("title"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def without_conversation(conversations: DataFrame, messages: DataFrame, conversation: str, user) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) without the user's conversation."""
    parent = (F.col("id") == conversation) & (F.col("user_id") == user)
    child = (F.col("conversation_id") == conversation) & (F.col("user_id") == user)
    return conversations.where(~parent), messages.where(~F.coalesce(child, F.lit(False)))


def touched(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with updated_at moved to their last message."""
    last = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("timestamp").alias("__last"))
    return conversations.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "__last")).drop("__last")


def messages_of(messages: DataFrame, conversation: str, user) -> DataFrame:
    return messages.where((F.col("conversation_id") == conversation) & (F.col("user_id") == user)).orderBy("id")


def without_user_messages(messages: DataFrame, user) -> DataFrame:
    return messages.where(F.col("user_id") != F.lit(user))


def conversation_summary(messages: DataFrame, conversation: str, order: str) -> DataFrame:
    """n_messages, n_user, last, last_role of each conversation."""
    return messages.groupBy(conversation).agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.max(order).alias("last"), F.max_by("role", order).alias("last_role"))


NEW_TITLE = "New conversation"


def new_conversations(wanted: DataFrame, now: Column) -> DataFrame:
    """Rows of conversations (id, user_id, title) that begin now; without a title, NEW_TITLE."""
    return wanted.select("id", "user_id", F.coalesce("title", F.lit(NEW_TITLE)).alias("title"), now.alias("created_at"), now.alias("updated_at"))


def with_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) after the new messages: their conversations move to the last of them."""
    return touched(conversations, new), messages.unionByName(new)


def chat_messages(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part (0, 1), role, content, sources: each question and its answer (question, answer, sources) as messages. A
    blank answer is an error and isn't kept."""
    user = F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("sources"))
    said = F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("sources").cast("string").alias("sources"))
    rows = answers.select(*keys, F.explode(F.array(user, said)).alias("m")).select(*keys, "m.*")
    return rows.where((F.col("part") == 0) | (F.coalesce(strip(F.col("content")), F.lit("")) != ""))


def with_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """users with the new ones whose name is free."""
    return insert_or_ignore(users, new, "username")


def with_password(users: DataFrame, hit: Column, password_hash: Column) -> DataFrame:
    return users.withColumn("password_hash", F.when(hit, password_hash).otherwise(F.col("password_hash")))


def logged_in(users: DataFrame, hit: Column, now: Column) -> DataFrame:
    return users.withColumn("last_login", F.when(hit, now).otherwise(F.col("last_login")))


def user_count(users: DataFrame, username: str) -> DataFrame:
    """One row: named (users of that name, active or not), there."""
    return users.where(F.col("username") == username).agg(F.count(F.lit(1)).alias("named")).withColumn("there", F.col("named") > 0)


def active_user(users: DataFrame, username: str) -> DataFrame:
    return users.where((F.col("username") == username) & (F.col("is_active") == 1))


def may_upload(role: Column) -> Column:
    return role.isin("admin", "super_user")


def may_administer(role: Column) -> Column:
    return role == "admin"
