"""Substring dedup by difference-cover anchors.

A window of WINDOW words counts as repeated if its word sequence also starts anywhere else. Only windows of
ANCHOR words that start at cover positions - places in the document that modulo PERIOD are in COVER - are
hashed and exchanged. COVER holds a pair of every difference, so two equal windows, wherever they start, share
an anchor at the same shift. Windows around a repeated anchor are then extended to WINDOW words and exchanged
by hashes of 128 bits in two independent lanes; those that repeat are removed. Both lanes mix every byte and word
with its place, so equal hashes of different words come by chance alone (about n^2 / 2^129 among n windows).

Defined results: null text has no words; a document of fewer than WINDOW words keeps all; a repeated row repeats
all its windows; ties don't arise, as every copy of a window is removed; extra columns are ignored; an empty
table gives an empty result; a very long text is one row, worked through in runs of RUN_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal, runs_of, text_buffers, window_hashes, with_fields, word_hashes, word_spans
from .parts import answers, arrays_of, asked, bucket_count, member, member_pairs, parts_of, repeated_here, repeated_keys, unpacked, with_answers

WINDOW = 35
#: A perfect difference set: each difference modulo PERIOD is that of one pair.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose words are worked on at once.
RUN_BYTES = 2_000_000

_SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)


class Run:
    """Words of some texts, or of a stretch of one long text: its words from place `begin` on, of which those before
    `stop` count as starts here. lanes: the words' hashes."""

    def __init__(self, rows: tuple[int, int], lanes: list[np.ndarray], before: np.ndarray, begin: int = 0, stop: int | None = None):
        self.rows, self.lanes, self.before = rows, lanes, before
        n = len(lanes[0])
        count = np.diff(before)
        self.place = begin + np.arange(n) - np.repeat(before[:-1], count)
        self.reach = np.repeat(before[1:], count) - np.arange(n)  # words from each to the end of its text here
        self.stop = n if stop is None else stop
        self.open = (self.reach >= WINDOW) & (np.arange(n) < self.stop)  # a window starts here

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, keys) of the cover positions at which an anchor stands, in documents that have a window. Those from
        `stop` on come again in the next run."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(cover[self.place % PERIOD] & (self.reach >= ANCHOR) & (self.place + self.reach >= WINDOW))
        return at, window_hashes(self.lanes[0], ANCHOR)[at]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys and checks of the windows that start there."""
        return window_hashes(self.lanes[0], WINDOW)[at], window_hashes(self.lanes[1], WINDOW, 1)[at]


def stretches(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches of about RUN_BYTES that end between words."""
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + RUN_BYTES)
        while end < len(data):
            gap = np.flatnonzero(np.isin(data[end : end + 4096], _SPACES))
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + 4096)
        yield begin, end
        begin = end


def runs(batch: pa.RecordBatch, lanes: int = 1) -> Iterator[Run]:
    """The words of a part. Of a long text each run begins with the words that the last one couldn't start from."""
    data, offsets = text_buffers(batch.column("text"))
    for i, j in runs_of(offsets, RUN_BYTES):
        own = data[offsets[i] : offsets[j]]
        if j - i > 1 or len(own) <= RUN_BYTES:
            starts, ends, before = word_spans(own, offsets[i : j + 1] - offsets[i])
            yield Run((i, j), [word_hashes(own, starts, ends, lane) for lane in range(lanes)], before)
            continue
        carried, place = [np.zeros(0, np.uint64)] * lanes, 0
        for a, b in stretches(own):
            part = own[a:b]
            starts, ends, _ = word_spans(part, np.array([0, len(part)]))
            hashes = [np.concatenate([c, word_hashes(part, starts, ends, lane)]) for lane, c in enumerate(carried)]
            n = len(hashes[0])
            stop = n if b == len(own) else max(0, n - WINDOW + 1)
            yield Run((i, j), hashes, np.array([0, n]), place, stop)
            carried, place = [h[stop:].copy() for h in hashes], place + stop


def ask_anchors(batch: pa.RecordBatch, _: list) -> dict[str, np.ndarray]:
    return {"key": np.unique(np.concatenate([np.zeros(0, np.uint64), *(r.anchors()[1] for r in runs(batch))]))}


def near_anchors(run: Run, hit: np.ndarray) -> np.ndarray:
    """The windows that hold one of the given anchors within their first PERIOD places."""
    edge = np.zeros(len(run.place) + 1, np.int64)
    np.add.at(edge, np.maximum(hit - PERIOD + 1, 0), 1)
    np.add.at(edge, hit + 1, -1)
    return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & run.open)


def ask_windows(batch: pa.RecordBatch, said: list[bytes]) -> dict[str, np.ndarray]:
    """The windows near a repeated anchor."""
    every = list(runs(batch, 2))
    anchors = [r.anchors() for r in every]
    own = np.concatenate([np.zeros(0, np.uint64), *(k[at < r.stop] for r, (at, k) in zip(every, anchors, strict=True))])
    known = np.sort(np.concatenate([np.unique(own[repeated_here(own)]), *(arrays_of(b)["key"] for b in said)]))
    key, check = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for r, (at, k) in zip(every, anchors, strict=True):
        x, y = r.windows(near_anchors(r, at[member(k, known)]))
        key.append(x)
        check.append(y)
    key, check = np.concatenate(key), np.concatenate(check)
    order = np.lexsort((check, key))
    key, check = key[order], check[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])] if len(key) else np.zeros(0, bool)
    return {"key": key[new], "check": check[new]}


def covered(every: list[Run], said: list[bytes]) -> list[np.ndarray]:
    """Which words of each run's own starts a repeated window covers; words past the last start of a run come with the
    next one."""
    got = [arrays_of(b) for b in said]
    known = np.concatenate([np.zeros(0, np.uint64), *(g["key"] for g in got)])
    checks = np.concatenate([np.zeros(0, np.uint64), *(g["check"] for g in got)])
    order = np.argsort(known, kind="stable")
    known, checks = known[order], checks[order]
    starts = [np.flatnonzero(r.open) for r in every]
    keys = [r.windows(at) for r, at in zip(every, starts, strict=True)]
    key, check = (np.concatenate([np.zeros(0, np.uint64), *(k[i] for k in keys)]) for i in (0, 1))
    repeated = repeated_here(key, check) | member_pairs(key, check, known, checks)
    out, at, over = [], 0, np.zeros(0, bool)
    for r, own in zip(every, starts, strict=True):
        edge = np.zeros(len(r.place) + 1, np.int64)
        hit = own[repeated[at : at + len(own)]]
        at += len(own)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        gone[: len(over)] |= over  # from windows that start in the run before
        over = gone[r.stop :]
        out.append(gone[: r.stop])
    return out


def kept_texts(batch: pa.RecordBatch, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words, removed words, kept words joined by one space) of each text. gone: of all words of the part."""
    data, offsets = text_buffers(batch.column("text"))
    count, removed, texts = [], [], []
    first = 0
    for i, j in runs_of(offsets, RUN_BYTES):
        pieces = [(offsets[i] + a, offsets[i] + b) for a, b in stretches(data[offsets[i] : offsets[j]])] if j - i == 1 else [(offsets[i], offsets[j])]
        out = []
        for a, b in pieces:
            edges = offsets[i : j + 1] - a if j - i > 1 else np.array([0, b - a])
            starts, ends, before = word_spans(data[a:b], edges)
            own = gone[first : first + len(starts)]
            first += len(starts)
            sums = np.r_[0, np.cumsum(own)]
            size = np.where(own, 0, ends - starts + 1)  # a space after each word
            ends_out = np.cumsum(size)
            raw = np.full(int(ends_out[-1]) if len(size) else 0, 0x20, np.uint8)
            keep = ~own
            lengths = (ends - starts)[keep]
            step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            raw[np.repeat((ends_out - size)[keep], lengths) + step] = data[a:b][np.repeat(starts[keep], lengths) + step]
            out.append((np.diff(before), np.diff(sums[before]), raw, np.r_[0, ends_out][before]))
        if j - i > 1:
            (words, lost, raw, cuts), text = out[0], None
            count.append(words)
            removed.append(lost)
            text = raw.tobytes()
            texts += [text[x : max(x, y - 1)] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        else:
            count.append(sum(o[0] for o in out) if out else np.zeros(1, np.int64))
            removed.append(sum(o[1] for o in out) if out else np.zeros(1, np.int64))
            texts.append(b"".join(o[2].tobytes() for o in out)[:-1])
    return np.concatenate(count), np.concatenate(removed), pa.array(texts, pa.binary()).cast(pa.string())


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the text of the kept words, joined by one space."""
    parts = parts_of(docs, text)
    # about 6 bytes a word
    anchors = answers(asked(parts, ask_anchors, bucket_count(docs, len(COVER) / PERIOD / 6, text)), repeated_keys)
    windows = answers(asked(with_answers(parts, anchors), ask_windows, bucket_count(docs, 0.5 / 6, text)), repeated_keys)
    schema = with_fields(docs.select("doc_id").schema, "n_words bigint, n_removed bigint, text string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = unpacked(batch.column("payload")[r].as_buffer())
                gone = covered(list(runs(own, 2)), batch.column("answers")[r].as_py() or [])
                count, removed, kept = kept_texts(own, np.concatenate([np.zeros(0, bool), *gone]))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), kept], schema.names)

    return with_answers(parts, windows).mapInArrow(frugal(cut), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
