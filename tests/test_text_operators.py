import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as tx
from quillspan.operators import headings, pages, prompt, quality
from quillspan.operators.metrics import decode_rate
from quillspan.plans import catalogue
from quillspan.sources.files import docx_text, extracted, uploads, xlsx_text
from quillspan.sources.html import html_text
from quillspan.sources.streams import ndjson_tokens, sse_tokens
from quillspan.streaming.tokens import text_repeats


def value(spark, column, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(column).first()[0]


@pytest.mark.parametrize(("text", "labels"), [
    ("Article 99\nPenalties\n\n1. The", ["Article 99 — Penalties"]),
    ("CHAPTER XII\nPENALTIES\n\nArticolo 99\nSanzioni\n\n1. x", ["CHAPTER XII — PENALTIES", "Articolo 99 — Sanzioni"]),
    ("Article 5\n1. The", ["Article 5"]),
    ("As Article 5 says, this is a long sentence", []),
    ("Section Overview", ["Section Overview"]),
    ("article the", []),
    ("  Art. 3  \n\nText", ["Art. 3"]),
    ("Article 1\nArticle 2\nà", ["Article 1", "Article 2 — à"]),
])
def test_headings(spark, text, labels):
    assert [h.label for h in value(spark, headings.headings(F.col("t")), t=text)] == labels


def test_heading_offsets_are_bytes(spark):
    assert [h.byte_offset for h in value(spark, headings.headings(F.col("t")), t="àà\n Article 1\nx")] == [5]


def test_heading_quirks(spark):
    marks = headings.headings(F.col("t"))
    text = "Article 1\nOne\n\nArticle 10\nTen"
    # a start on the newline before a heading still sees the one before
    assert value(spark, headings.heading_at(marks, F.lit(14)), t=text) == "Article 1 — One"
    assert value(spark, headings.heading_at(marks, F.lit(15)), t=text) == "Article 10 — Ten"
    assert value(spark, headings.heading_at(marks, F.lit(0)), t="none") is None
    # a chunk of Article 10 counts as carrying Article 1; only the chunk's leading white space is left out
    assert value(spark, headings.with_heading(F.col("c"), F.col("l")), c="\n Article 10", l="Article 1 — One") == "\n Article 10"
    assert value(spark, headings.with_heading(F.col("c"), F.col("l")), c="x", l="Article 1") == "[Article 1]\n\nx"


@pytest.mark.parametrize(("span", "expected"), [((10, 50), (1, 1)), ((90, 110), (1, 2)), ((90, 100), (1, 1)), ((100, 110), (2, 2)), ((300, 310), None)])
def test_pages_for_range(spark, span, expected):
    spans = F.expr("array(named_struct('page', 1, 'start_byte', 0L, 'end_byte', 100L), named_struct('page', 2, 'start_byte', 100L, 'end_byte', 200L))")
    got = value(spark, pages.pages_for_range(spans, F.lit(span[0]), F.lit(span[1])))
    assert (tuple(got) if got else None) == expected


def test_folded_pages(spark):
    p = F.array(F.lit("à"), F.lit("  "), F.lit("bc"))
    native = value(spark, pages.folded_pages(p))
    assert native.text == "à\nbc\n"
    assert [tuple(s) for s in native.spans] == [(1, 0, 3), (3, 3, 6)]
    assert len(value(spark, pages.folded_pages(p, keep_blank=True)).spans) == 3
    assert value(spark, pages.text_ratio(F.array().cast("array<string>"))) == 0.0
    assert value(spark, pages.native_text_accepted(F.array(F.lit("x" * 501)))) is True
    assert value(spark, pages.native_text_accepted(F.array(F.lit("x" * 500)))) is False
    assert value(spark, pages.native_text_accepted(F.array(F.lit("x" * 501), F.lit("")))) is False


@pytest.mark.parametrize(("path", "name"), [("../../etc/passwd", "passwd"), ("sub/", "unnamed"), ("a\\b.txt", "b.txt"), ("..", "unnamed"), (".", "unnamed"), ("", "unnamed")])
def test_safe_name(spark, path, name):
    assert value(spark, tx.safe_name(F.col("p")), p=path) == name


@pytest.mark.parametrize(("name", "extension"), [("a.TXT", "txt"), ("a", ""), (".bashrc", ""), ("a.tar.GZ", "gz"), ("a.", "")])
def test_extension(spark, name, extension):
    assert value(spark, tx.file_extension(F.col("n")), n=name) == extension


def test_small_functions(spark):
    assert value(spark, tx.provenance_id(F.lit("abc123"), F.lit(5))) == "abc123:5:pv1:cv2"
    assert [value(spark, tx.byte_label(F.lit(n))) for n in (2048, 3 << 20, 5 << 30)] == ["2 KB", "3 MB", "5.0 GB"]
    assert [value(spark, tx.duration_label(F.lit(n))) for n in (5, 65, 3700)] == ["5s", "1m05s", "1h01m"]
    assert value(spark, tx.version_parts(F.lit("v1.10.2")) > tx.version_parts(F.lit("1.9.9"))) is True
    assert value(spark, decode_rate(F.lit(11), F.lit(500.0), F.lit(1500.0))) == 10.0
    assert value(spark, decode_rate(F.lit(1), F.lit(500.0), F.lit(1500.0))) is None
    assert value(spark, tx.word_count(F.lit("  a b c\n"))) == 3
    assert value(spark, tx.is_archive_name(F.lit("b.tar.gz"))) and not value(spark, tx.is_archive_name(F.lit("x/b.tar.gz")))


def test_history_of_odd_rows(spark):
    rows = [(1, i, role, f"{role}{i}") for i, role in enumerate(["system", "user", "user", "assistant", "assistant", "user"])]
    rows += [(2, 0, "system", "s")]
    got = {r.conv_id: r for r in prompt.histories(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), "conv_id", "turn").collect()}
    assert got[1].history == "CONVERSATION HISTORY:\nUser: user2\nAssistant: assistant3"
    assert (got[2].n_pairs, got[2].history) == (0, "")


def test_slots_inside_earlier_values_are_filled(spark):
    got = value(spark, prompt.filled("{context}|{question}", {"context": F.lit("see {question}"), "question": F.lit("why")}))
    assert got == "see why|why"


def test_chat_cleaning(spark):
    assert value(spark, prompt.without_thoughts(F.lit("<think>a\nb</think> x <think>open"))) == "x <think>open"
    assert "<|im_start|>tail" in value(spark, prompt.chat_wrapped(F.lit("<|im_start|>system\nhi<|im_start|>tail")))


@pytest.mark.parametrize("text", ["", "short", "abcdefghij" * 40, "à" * 500, " " * 900, "x" * 149, "x" * 200, "é" + "no repeat here " * 3, "".join(map(str, range(900))), "The same phrase of about fifty code points, again. " * 5, "😀" * 300])
def test_repetition_guard(spark, text):
    assert value(spark, quality.repeats(F.col("t")), t=text) == text_repeats(text)


def test_html():
    page = '<html><head><title>no</title><script>var t="</p><p>no"</script></head><body><div>no<p>one &amp;amp; <b>two<p>three<ul><li><p>in</p> li<li>next</ul><table><tr><td>a<td>b</table><h2> h </h2><!-- <p>no --></body>'
    assert html_text(page) == "one &amp; two\nthree\nin li\nin\nnext\na\nb\nh"
    assert html_text(None) == ""


def test_html_cut_references(spark, tmp_path):
    """Titles that are cut within a reference: the operator reads them as browsers do, the query as its SQL does."""
    pages = ["<h1>a&&amp</h1><p>b &amp; c&am</p>", "<p>&amp;amp &ampere; &copy &copy; &quot</p>", "<p>&</p><li>&middot;&middot</li>", "<td>x & y &lt;b&gt; &#</td>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {tuple(r) for r in catalogue.html_extract(spark, str(tmp_path)).select("page_id", "text").collect()}
    assert got == set(con.sql(catalogue.ORACLES["html_extract"]).fetchall())
    assert html_text(pages[0]) == "a&&\nb & c&am"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOCX = {"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> you</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}
XLSX = {
    "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>x</t></si></sst>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row><c t="s"><v>0</v></c><c><v>2.5</v></c></row></sheetData></worksheet>',
}


def test_office_files():
    assert docx_text(zipped(DOCX)) == "Hello you\na\tb\t\n"
    assert xlsx_text(zipped(XLSX)) == "x\t2.5\n"


def test_file_source(spark, tmp_path):
    (tmp_path / "a.md").write_text("# à")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.docx").write_bytes(zipped(DOCX))
    (tmp_path / "e.txt").write_bytes(b"")
    got = {r.filename: r for r in extracted(uploads(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.md", "b.txt", "c.pdf", "d.docx"}  # the scan passes over empty files
    empty = extracted(spark.createDataFrame([("e.txt", "txt", bytearray())], "filename string, extension string, content binary")).first()
    assert empty.text is None and empty.error == "empty file"
    assert got["a.md"].text == "# à" and got["a.md"].error is None
    assert got["b.txt"].text is None and "Unicode" in got["b.txt"].error
    assert got["c.pdf"].error == "unsupported format"
    assert got["d.docx"].text.startswith("Hello you")


def test_token_streams(spark):
    nd = spark.createDataFrame([(1, '{"response":"a"}\n\nbad\n{"response":"b"}\n{"response":"c"}')], "stream_id int, body string")
    assert [r.token for r in ndjson_tokens(nd).orderBy("seq").collect()] == ["a", "b"]  # the last line has no newline
    sse = spark.createDataFrame([(1, 'data: {"token":"a"}\n\n: x\ndata: {"token":"b"}\n\ndata: {"done":true}\n\ndata: {"token":"c"}\n\n')], "stream_id int, body string")
    assert [r.token for r in sse_tokens(sse).orderBy("seq").collect()] == ["a", "b"]
