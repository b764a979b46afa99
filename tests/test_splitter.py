import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.operators.splitter import OVERLAP, SIZE, packed_run, recursive_chunks, split_text, window_chunks

GOLDEN = [
    ("", []),
    (("word " * 300).rstrip(), [(0, 999), (900, 1499)]),
    ("a" * 2500, [(0, 1000), (900, 1900), (1800, 2500)]),
    ("à" * 2500, [(0, 2000), (1800, 3800), (3600, 5000)]),
    ("a" * 1000, [(0, 1000)]),
    ("a" * 1000 + " b", [(0, 1000), (1001, 1002)]),
    ("a  b", [(0, 4)]),
    ("x\n\n\ny", [(0, 5)]),
    ("   ", []),
    ("\n\n\n\n", []),
    ("  \n ", [(0, 4)]),
    ("a" * 499 + " " + "b" * 500, [(0, 1000)]),
    ("a" * 500 + " " + "b" * 500, [(0, 500), (501, 1001)]),
    ("p1\n\n" + "c" * 1500 + "\n\np2", [(0, 2), (4, 1004), (904, 1504), (1506, 1508)]),
]


@pytest.mark.parametrize(("text", "spans"), GOLDEN)
def test_spans(text, spans):
    assert [(a, b) for _, a, b in split_text(text)] == spans


def test_collapsed_separators_are_not_the_slice():
    assert split_text("a  b")[0][0] == "a b"
    assert split_text("x\n\n\ny")[0][0] == "x\n\n\ny"


def literal_run(pieces, gap):
    """The packing rule stated by a sliding window."""
    out, window = [], []
    size = lambda w: sum(map(len, w)) + gap * max(len(w) - 1, 0)
    for p in pieces:
        if window and size([*window, p]) > SIZE:
            out.append(list(window))
            while window and (size(window) > OVERLAP or size([*window, p]) > SIZE):
                window.pop(0)
        window.append(p)
    if window:
        out.append(list(window))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 60), st.integers(1, 999)), max_size=60), st.sampled_from([" ", "\n\n"]))
def test_packing_is_the_sliding_window(lengths, separator):
    pieces = ["x" * n for n in lengths]
    starts = [0] * len(pieces)
    assert [t for t, _, _ in packed_run(pieces, starts, separator)] == [separator.join(w) for w in literal_run(pieces, len(separator))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab à\n€😀", max_size=4000))
def test_invariants(text):
    raw = text.encode()
    chunks = split_text(text)
    starts = [a for _, a, _ in chunks]
    assert starts == sorted(set(starts))
    covered = set()
    for t, a, b in chunks:
        assert len(t) <= SIZE
        own = raw[a:b].decode()
        assert "".join(own.split()) == "".join(t.split())
        covered.update(range(a, b))
    left = bytes(raw[i] for i in range(len(raw)) if i not in covered)
    assert not left.strip(b" \n")


def test_windows_of_one_code_point_past_the_end():
    assert [(a, b) for _, a, b in window_chunks("a" * 1001, 5)] == [(5, 1005), (905, 1006)]


def test_null_and_empty_texts_have_no_chunks(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    assert [tuple(r) for r in recursive_chunks(docs, ["doc_id"]).collect()] == [(3, 0, "x", 0, 1)]


def test_labels_of_many_headings(spark):
    """The label that comes with a chunk is that of the expression over all marks."""
    from pyspark.sql import functions as F

    from quillspan.operators import headings, splitter

    texts = ["".join(f"Article {i}\nà{'x ' * (i % 900)}\n" for i in range(1, 700)), "none at all", "", None, "x\n\nSection A\n" + "y " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("marks", headings.headings(F.col("text")))
    got = splitter.recursive_chunks(docs, ["id", "marks"], marks="marks")
    assert got.where(~F.col("label").eqNullSafe(headings.heading_at(F.col("marks"), F.col("start_byte")))).count() == 0
    assert got.where("id = 0").agg(F.countDistinct("label")).first()[0] > 300
    raw = texts[0].encode()
    marks = docs.where("id = 0").select(F.inline("marks")).collect()
    assert len(marks) == 699 and all(raw[m.byte_offset :].startswith(m.label.split(" — ")[0].encode() + b"\n") for m in marks)
