"""The repetition guard on generated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAIL_BYTES = 800
LEAST_BYTES = 150
PHRASE = 50
STRIDE = 25
REPEATS = 3
CHECK_AFTER = 80
CHECK_EVERY = 20


def tail(text: Column) -> Column:
    """The last TAIL_BYTES bytes, from the first whole code point on."""
    raw = F.encode(text, "UTF-8")
    last = F.when(F.length(raw) > TAIL_BYTES, F.substring(raw, -TAIL_BYTES, TAIL_BYTES)).otherwise(raw)
    # a cut code point leaves at most three continuation bytes
    lead = F.length(F.regexp_extract(F.substring(F.hex(last), 1, 6), "^([89AB][0-9A-F])*", 0)) / 2
    return F.decode(F.substring(last, (lead + 1).cast("int"), F.lit(TAIL_BYTES)), "UTF-8")


def repeats(text: Column) -> Column:
    """Whether a phrase of the text's tail stands there three times or more. Phrases are taken every STRIDE code
    points; all-blank ones don't count, nor do texts with a short tail."""

    def judge(t: Column) -> Column:
        n = F.length(t)
        starts = F.when(n >= PHRASE, F.sequence(F.lit(0), n - PHRASE, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))

        def again(i: Column) -> Column:
            phrase = F.substring(t, i + 1, F.lit(PHRASE))
            return phrase.rlike(r"(?U)\S") & ((n - F.length(F.replace(t, phrase, F.lit("")))) / PHRASE >= REPEATS)

        return (F.octet_length(t) >= LEAST_BYTES) & F.exists(starts, again)

    # bound once; inlined, the tail would be cut anew for every phrase
    return F.transform(F.array(tail(text)), judge)[0]
