"""The token fold as a stateful stream: text, count and first time of each answer, ended by its last token or by the
repetition guard."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from quillspan.operators.quality import CHECK_AFTER, CHECK_EVERY, LEAST_BYTES, PHRASE, REPEATS, STRIDE, TAIL_BYTES

FOLDED = "stream_id bigint, n_tokens bigint, first_ts timestamp, answer string, stopped boolean, done boolean"
_STATE = "n bigint, first timestamp, answer string, stopped boolean, done boolean"


def text_repeats(text: str) -> bool:
    """The guard of operators.quality on one text."""
    raw = text.encode()[-TAIL_BYTES:]
    while raw and raw[0] & 0xC0 == 0x80:
        raw = raw[1:]
    if len(raw) < LEAST_BYTES:
        return False
    tail = raw.decode()
    phrases = (tail[i : i + PHRASE] for i in range(0, len(tail) - PHRASE + 1, STRIDE))
    return any(p.strip() and tail.count(p) >= REPEATS for p in phrases)


def _fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, first, answer, stopped, done = state.get if state.exists else (0, None, "", False, False)
    rows = pd.concat(list(batches)).sort_values("seq")
    for ts, token, last in zip(rows["ts"], rows["token"], rows["done"], strict=True):
        if stopped or done:
            break
        if token:
            n, answer = n + 1, answer + token
            first = first if first is not None else ts
            stopped = n >= CHECK_AFTER and (n - CHECK_AFTER) % CHECK_EVERY == 0 and text_repeats(answer)
        done = done or bool(last)
    state.update((n, first, answer, stopped, done))
    yield pd.DataFrame({"stream_id": [key[0]], "n_tokens": [n], "first_ts": [first], "answer": [answer], "stopped": [stopped], "done": [done]})


def folded_stream(tokens: DataFrame) -> DataFrame:
    """The state of each stream after every micro-batch that brought it tokens. tokens: stream_id, seq, ts, token, done."""
    return tokens.groupBy("stream_id").applyInPandasWithState(_fold, FOLDED, _STATE, "update", "NoTimeout")
