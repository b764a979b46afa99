"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words; the document's score
is the noisy-or of its sentences and a leak, 1 - (1 - leak) * prod(1 - s_i). Only document labels are learned
from; the sentence scores then locate the offending sentences. A sentence's features are its words and, from
SENTENCE_WORDS words on, itself as a whole, so that copies of a labelled text are known again without their words being
held against other texts.

Texts become hashes of words where they are read. Which features weigh is counted by distributed aggregates; only the
sentences that hold one, as numbers of features, go to the driver, where the weights are fitted.

Defined results: null or empty text has no sentences and scores the leak; repeated rows score alike; of rows with one
doc_id the least text is learned from, and of labels the largest; ties of the sample go by doc_id; columns named like a
result give way to it in score() and are kept by without_toxic(); an empty table gives an empty result; with nothing to
learn from, every score is 0; a very long text is worked through in stretches that end with a sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, TEXT, arrow_of, documents, frugal, learnable, mix, runs_of, scratch, text_buffers, word_hashes, written

#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
#: A word or whole sentence weighs if the chance of any such lean to the label among all of them is below this.
CHANCE = 0.05
#: And if it leans to the label by this factor at least (or halfway to always): in a large sample a word that is hardly
#: commoner in toxic sentences is no chance either, but a long text holds it a thousand times.
LEAN = 2.0
#: Words that a sentence needs to weigh as a whole.
SENTENCE_WORDS = 3
#: Weight that every sentence starts from: a sentence of unknown words is all but surely clean.
CLEAN = -12.0
ROUNDS = 300

_BASE = 0x9E3779B97F4A7C15
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256), 39]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the words that weigh
    weights: np.ndarray
    leak: float


def sentence_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sentence, text) of each word, and the bytes at which sentences end. Sentences are numbered over all
    texts: one more at each stop and at each text's start."""
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    hashes = word_hashes(_LOWER[data], starts, ends)
    cuts = np.flatnonzero(_STOP[data] | edge[1:]) + 1
    sentence = np.searchsorted(cuts, starts, "right")
    text = np.searchsorted(offsets, starts, "right") - 1
    return hashes, sentence, text, cuts


def with_sentences(hashes: np.ndarray, sentence: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence, text): the words, and each sentence of some words as a whole."""
    if not len(hashes):
        return hashes, sentence, text
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    size = np.diff(np.r_[first, len(sentence)])
    use = size >= SENTENCE_WORDS
    return np.r_[hashes, whole_hashes(hashes, first, size)[use]], np.r_[sentence, sentence[first][use]], np.r_[text, text[first][use]]


def stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, first byte, last byte) of runs of texts; a long text comes in stretches that each end
    with a sentence."""
    for i, j in runs_of(offsets):
        begin, end = int(offsets[i]), int(offsets[j])
        while j == i + 1 and end - begin > CHUNK_BYTES:
            cut = begin + CHUNK_BYTES
            while cut < end and not _STOP[data[cut : cut + 4096]].any():
                cut += 4096
            if cut >= end:
                break
            cut += int(np.argmax(_STOP[data[cut : cut + 4096]])) + 1
            yield i, j, begin, cut
            begin = cut
        yield i, j, begin, end


def bags(rows: DataFrame) -> DataFrame:
    """doc_id, toxic, content (a hash of the sentence's words), n (times that the document holds it), whole (whether it
    weighs as a whole), words (its different ones) of every different sentence of rows (doc_id, toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "toxic", "content", "n", "whole", "words"]
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j, a, b in stretches(data, offsets):
                own = np.clip(offsets[i : j + 1], a, b) - a
                word, sentence, text, _ = sentence_words(data[a:b], own)
                if not len(word):
                    continue
                first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
                size = np.diff(np.r_[first, len(sentence)])
                content = whole_hashes(word, first, size)
                pair, at, count = np.unique(np.stack([text[first].astype(np.uint64), content], 1), axis=0, return_index=True, return_counts=True)
                words = [np.unique(word[first[k] : first[k] + size[k]]).view(np.int64) for k in at.tolist()]
                edges = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int32)
                row = pa.array(pair[:, 0].astype(np.int64) + i)
                held = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(words)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(pair[:, 1].astype(np.int64)), pa.array(count, pa.int64()), pa.array(size[at] >= SENTENCE_WORDS), held], names)

    schema = "doc_id bigint, toxic int, content bigint, n bigint, whole boolean, words array<bigint>"
    return rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(frugal(run), schema)


def whole_hashes(word: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each sentence's words in order."""
    place = (np.arange(len(word)) - np.repeat(first, size)).astype(np.uint64)
    return mix(np.add.reduceat(mix(word + place * np.uint64(_BASE)), first) + np.uint64(1))


def leans(has: Column, hits: Column, rate: float, features: int) -> Column:
    """Whether a feature leans to the label, of `features` that a chance is shared out among: the chance that one held
    by `has` units leans so far is bounded by exp(-has * divergence)."""
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), hits / has))
    divergence = p * F.log(p / rate) + (1 - p) * F.log((1 - p) / (1 - rate))
    return (p >= min(LEAN * rate, (1 + rate) / 2)) & (has * divergence >= float(np.log(max(features, 1) / CHANCE)))


def weighing(held: DataFrame) -> list[tuple[int, float, float]]:
    """(feature, units that hold it, toxic ones) of the features that weigh. A word's units are the different sentences,
    so that copies of a text teach it no words, and those are toxic that stand mostly in toxic texts; a whole sentence's
    units are the texts."""
    n = F.sum("n")
    toxic = F.sum(F.col("n") * F.col("toxic"))
    sentences = held.groupBy("content").agg(F.count(F.lit(1)).alias("has"), F.sum("toxic").alias("hits"), (toxic / n > 0.5).cast("int").alias("mark"), F.first("whole").alias("whole"), F.first("words").alias("words"))
    sentences = written(sentences, "toxic-sentences")
    per = sentences.agg(F.avg("mark"), F.count_if("whole")).first()
    words = written(sentences.select(F.explode("words").alias("feature"), "mark").groupBy("feature").agg(F.count(F.lit(1)).alias("has"), F.sum("mark").alias("hits")), "toxic-words")
    texts = held.where("whole").select("doc_id", "toxic").distinct().agg(F.avg("toxic")).first()[0]
    chosen = words.where(leans(F.col("has"), F.col("hits"), per[0] or 0.5, words.count()))
    if per[1]:
        wholes = sentences.where("whole").select(F.col("content").alias("feature"), "has", "hits")
        chosen = chosen.unionByName(wholes.where(leans(F.col("has"), F.col("hits"), texts, per[1])))
    return [(r.feature, float(r.has), float(r.hits)) for r in chosen.toLocalIterator()]  # bounded by the sample


def train(feature: np.ndarray, has: np.ndarray, hits: np.ndarray, sent: np.ndarray, held: np.ndarray, of: np.ndarray, times: np.ndarray, toxic: np.ndarray) -> Model:
    """Noisy-or log likelihood by Adam. Sentence sent[i] holds feature held[i]; sentence s stands times[s] times in text
    of[s]; toxic: the texts' labels."""
    n, positive = len(toxic), float(toxic.sum())
    rate = min(max(positive / max(n, 1), 1e-6), 1 - 1e-6)
    odds = np.log((hits + 0.1) / (positive + 0.2)) - np.log((has - hits + 0.1) / (n - positive + 0.2))
    w = np.where(odds > 0, -CLEAN + odds - 4, odds)
    leak = np.log(rate / 2 / (1 - rate / 2))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    y = toxic.astype(float)
    for step in range(1, ROUNDS + 1):
        z = CLEAN + np.bincount(sent, weights=w[held], minlength=len(times))
        s = 1 / (1 + np.exp(-np.clip(z, -40, 30)))
        q = 1 / (1 + np.exp(-leak))
        clean = np.bincount(of, weights=times * np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=n) + np.log1p(-q)
        p = np.clip(-np.expm1(clean), 1e-9, 1)
        pull = y / p - 1  # derivative of the log likelihood by each -log(1 - s)
        grad = np.bincount(held, weights=(pull[of] * s * times)[sent], minlength=len(w)) - 0.05 * (w - np.where(odds > 0, -CLEAN, 0))
        g = np.append(grad, (pull * q).sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, leak = w + move[:-1], min(leak + move[-1], -0.9)
    return Model(feature, w, float(1 / (1 + np.exp(-leak))))


def sentence_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, score) of the sentences that hold a word which weighs."""
    h, s, d, cuts = sentence_words(data, offsets)
    h, s, d = with_sentences(h, s, d)
    at = np.minimum(np.searchsorted(model.words, h), max(len(model.words) - 1, 0))
    hit = np.flatnonzero(model.words[at] == h) if len(model.words) else np.zeros(0, np.int64)
    once, index = np.unique(s[hit].astype(np.int64) * max(len(model.words), 1) + at[hit], return_index=True)
    hit = hit[index]
    sentences, back = np.unique(s[hit], return_inverse=True)
    z = CLEAN + np.bincount(back, weights=model.weights[at[hit]], minlength=len(sentences))
    text = np.zeros(len(sentences), np.int64)
    text[back] = d[hit]
    ends = cuts[sentences] if len(sentences) else sentences
    starts = np.where(sentences > 0, cuts[np.maximum(sentences, 1) - 1], 0) if len(sentences) else sentences
    return text, np.maximum(starts, offsets[text]), ends, 1 / (1 + np.exp(-np.clip(z, -40, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """From a bounded sample of labelled rows."""
    with scratch():
        return _fitted(docs, labels, text)


def _fitted(docs: DataFrame, labels: DataFrame, text: str) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.least(F.greatest(F.max("toxic"), F.lit(0)), F.lit(1)).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")  # SAMPLE_ROWS small rows
    rows = written(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "toxic-rows")
    texts = [tuple(r) for r in rows.select("doc_id", "toxic").orderBy("doc_id").collect()]  # SAMPLE_ROWS
    toxic = np.array([t for _, t in texts], np.int64)
    rate = float(toxic.mean()) if len(texts) else 0.0
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), rate)
    if rate in (0.0, 1.0):
        return nothing
    held = written(bags(rows), "toxic-bags")
    features = sorted((np.int64(f).astype(np.uint64), has, hits) for f, has, hits in weighing(held))
    if not features:
        return nothing
    known_features = np.array([f for f, _, _ in features], np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(known_features)  # features that weigh, bounded by the sample

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        for batch in batches:
            words = batch.column(3)
            flat = words.flatten().to_numpy().view(np.uint64)
            at = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            whole = batch.column(4).to_numpy(zero_copy_only=False)
            content = batch.column(1).to_numpy().view(np.uint64)
            value, row = np.r_[flat, content[whole]], np.r_[at, np.flatnonzero(whole)]
            place = np.minimum(np.searchsorted(every, value), len(every) - 1)
            hit = every[place] == value
            row, place = row[hit], place[hit]
            order = np.argsort(row, kind="stable")
            row, place = row[order], place[order]
            rows, first = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(place, pa.int64()))
            picked = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(2).take(picked), lists], ["doc_id", "n", "held"])

    found = held.select("doc_id", "content", "n", "words", "whole").mapInArrow(marked, "doc_id bigint, n bigint, held array<bigint>")
    doc, times, lists = [], [], []
    for r in found.orderBy("doc_id", "n", "held").toLocalIterator():  # sentences of the sample that hold a feature that weighs
        doc.append(r.doc_id)
        times.append(r.n)
        lists.append(r.held)
    sizes = np.array([len(x) for x in lists], np.int64)
    ids = np.array([d for d, _ in texts], np.int64)
    of = np.searchsorted(ids, np.array(doc, np.int64))
    return train(known_features, np.array([h for _, h, _ in features]), np.array([t for _, _, t in features]), np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.zeros(0, np.int64), *map(np.array, lists)]).astype(np.int64), of, np.array(times, float), toxic)


def document_scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """The score of each text, and (text, start, end, score) in its bytes of the sentences that score THRESHOLD or more."""
    data, offsets = text_buffers(texts)
    clean = np.full(len(offsets) - 1, np.log1p(-model.leak))
    places = []
    for i, j, a, b in stretches(data, offsets):
        d, start, end, s = sentence_scores(model, data[a:b], np.clip(offsets[i : j + 1], a, b) - a)
        clean[i:j] += np.bincount(d, weights=np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=j - i)
        shift = a - offsets[i:j][d]
        places += [(int(i + d[k]), int(start[k] + shift[k]), int(end[k] + shift[k]), float(s[k])) for k in np.flatnonzero(s >= THRESHOLD)]
    return -np.expm1(clean), places


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", locate: bool = False) -> DataFrame:
    """The kept columns with score; with locate also `sentences`, array<struct<start,end,score>> in UTF-8 bytes, of
    the sentences that score THRESHOLD or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some hundred weights
    schema = arrow_of(docs, keep, "score double" + ", sentences array<struct<start:bigint,end:bigint,score:double>>" * locate)
    keep = schema.names[: -1 - locate]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, places = document_scores(sent.value, batch.column(len(keep)))
            out = [*(batch.column(c) for c in range(len(keep))), pa.array(scores)]
            if locate:
                lists: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for d, a, b, s in places:
                    lists[d].append({"start": a, "end": b, "score": s})
                out.append(pa.array(lists, kind))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return docs.select(*keep, F.col(text).alias(TEXT)).mapInArrow(frugal(run), schema)


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, all columns as they are, without the rows that score THRESHOLD or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some hundred weights
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(document_scores(sent.value, batch.column(at))[0] < THRESHOLD))

    return docs.mapInArrow(frugal(run), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(learnable("doc_id")))
    out = score(docs, model, ["doc_id"], locate=True)
    return out.select("doc_id", (~learnable("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences")
