"""Patterns, files and pages against plain Python on boundary texts."""

import io
import re
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abacist.functions import harm, pii
from abacist.operators import feedback, safety
from abacist.plans import texts
from abacist.plans.views import view
from abacist.sources import documents

TEXTS = [
    "", None, "mail a.b+c@uni.example or x@y.zz|", "é.x@y.com", "éx@y.com", "call 555-123-4567", "5551234567", "١٢٣-٤٥-٦٧٨٩",
    "123-45-6789", "1234 5678 1234 5678", "1234 5678-1234 5678", "10.0.0.1", "300 Main St.", "12 é", "12 avecé",
    "John Smith", "jean éric", "Ab Cd Ef Gh", "one\rtwo", "a b", "x 1.2.3.4é", "tel:555.123.4567é", "ſam Kate",
    "İstanbul ırak", "a_b c_d", "Anna  \n Berg", "id 123456789012345 end",
]
HARMFUL = [
    "", None, "they attack\rsome people", "attack\nsome people", "attack people", "KILL that PERSON", "skill a person",
    "éhate", "hate", "a knife to use", "use a knife", "self-harm", "graphic material", "sell drug", "drug we sell",
    "fake id", "fake idé", "porn", "x" * 200 + " nazi", "hate and porn and bomb to build",
]


def python_detect(text):
    return [k for k, p in pii.PATTERNS.items() if text and re.search(p, text, re.IGNORECASE)]


def python_redact(text):
    out = text or ""
    for kind, pattern in pii.PATTERNS.items():
        if text and re.search(pattern, text, re.IGNORECASE):
            out = re.sub(pattern, f"[REDACTED_{kind.upper()}]", out, flags=re.IGNORECASE)
    return out


def test_pii_on_boundary_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i INT, text STRING")
    rows = df.select("i", "text", pii.detected(F.col("text")).alias("d")).select(
        "d", pii.redacted(F.col("text"), F.col("d")).alias("r"), pii.passes_gate(F.col("text")).alias("g"), "i").orderBy("i").collect()
    for text, row in zip(TEXTS, rows):
        assert row.d == python_detect(text), text
        assert row.r == python_redact(text), text
        if text is not None:
            assert row.g == (not any(re.search(p, text) for p in pii.GATE_PATTERNS)), text


def test_pii_on_whole_documents(spark):
    rows = feedback.redact(view(spark, "/root/testdata/sf0.001", "pii_text"), "text").collect()
    for row in rows:
        assert row.pii_types == python_detect(row.text)
        assert row.sanitized_text == python_redact(row.text)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet="aZé1@.- \n_,9ß\u0130\u017f", max_size=60), min_size=20, max_size=60))
def test_pii_on_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    for row in feedback.redact(df, "text").collect():
        assert row.pii_types == python_detect(row.text), repr(row.text)
        assert row.sanitized_text == python_redact(row.text), repr(row.text)


def test_ingest_rejects_and_flags(spark):
    df = spark.createDataFrame(
        [("1", "u", "correction", None, "fine", None), ("2", "u", "correction", True, "call 555-123-4567", None),
         ("3", "u", None, None, None, "mail a@b.co"), ("4", "u", "rating", False, None, None)],
        "id STRING, user_id STRING, type STRING, consent_given BOOLEAN, correction STRING, flagged_content STRING").withColumns(
        {"rating": F.lit(3), "session_id": F.lit("s"), "chat_id": F.lit("c"), "model_version_id": F.lit("m"),
         "metadata": F.when(F.col("id").isin("2", "3"), F.create_map(F.lit("page"), F.lit("p"), F.lit("ip_address"), F.lit("1.2.3.4"))),
         "created_at": F.lit(None).cast("timestamp")})
    rows = {r.id: r for r in feedback.ingest(df).collect()}
    assert rows["1"].reject_reason == "consent required" and rows["1"].pii_sanitized
    assert rows["2"].reject_reason is None and not rows["2"].pii_sanitized and rows["2"].user_correction == "call 555-123-4567"
    assert rows["3"].feedback_type == "general" and rows["3"].flagged_content == "mail [REDACTED_EMAIL]"
    assert rows["3"].metadata_json == '{"page":"p","ip_region":"1.2.x.x","pii_detected":["email"],"pii_sanitization_performed":true}'
    assert (rows["3"].session_id, rows["3"].chat_id, rows["3"].model_version_id) == ("s", "c", "m")
    assert rows["4"].metadata_json is None and rows["4"].pii_sanitized


def python_safety(text, age):
    low = (text or "").lower()
    found = [(c, p) for c, ps in harm.PATTERNS.items() for p in ps if re.search(p, low, re.IGNORECASE)]
    score = max([harm.SEVERITY[c] for c, _ in found], default=0.0)
    if age < 18 and any(c == "explicit_content" for c, _ in found):
        score += 0.5
    return found, score


@pytest.mark.parametrize("age", [17, 18])
def test_content_safety(spark, age):
    df = spark.createDataFrame([(i, t, age) for i, t in enumerate(HARMFUL)], "i INT, text STRING, age INT")
    for text, row in zip(HARMFUL, safety.content_safety(df, "text", "age").orderBy("i").collect()):
        found, score = python_safety(text, age)
        assert [(v.category, v.pattern) for v in row.violations] == found, text
        assert row.severity_score == pytest.approx(score) and row.is_safe == (score < 0.7), text
        advice = [a for c in harm.ADVICE if c in {f[0] for f in found} for a in harm.ADVICE[c]]
        assert row.recommendations == ([] if score < 0.7 else advice)


def test_snippet_length(spark):
    texts = ["hate " + "x" * (n - 5) for n in (199, 200, 201)]
    df = spark.createDataFrame([(str(i), "u", t) for i, t in enumerate(texts)], "id STRING, user_id STRING, message STRING")
    rows = safety.incidents_of(safety.moderate(df.withColumn("created_at", F.lit(None).cast("timestamp")))).orderBy("id").collect()
    assert [r.content_snippet for r in rows] == [texts[0], texts[1], texts[2][:200] + "..."]
    assert {r.severity for r in rows} == {"low"}  # 0.8 is not above 0.8


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, text in members.items():
            archive.writestr(name.replace("__", "/") + ".xml", text)
    return buffer.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DOCX = zipped(word__document=f'<w:document {W}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/>'
                             f'<w:p><w:r><w:t>Two</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body></w:document>')
XLSX = zipped(xl__sharedStrings=f"<sst {S}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
              xl__worksheets__sheet1=f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>0</v></c><c t="b"><v>1</v></c></row>'
                                     f'<row><c t="s"><v>1</v></c><c/><c><v>2.5</v></c><c t="inlineStr"><is><t>in</t></is></c></row>'
                                     f"</sheetData></worksheet>")
FILES = [
    ("Notes.TXT", "héllo".encode() + b"\xff\xfe!", "txt", "héllo!"), ("plain", b"abc", "plain", "abc"), ("a.b.docx", DOCX, "docx", "One line\n\nTwo\tx\n"),
    ("s.xlsx", XLSX, "xlsx", "name True\nab 2.5 in\n"), ("bad.docx", b"no zip", "docx", ""), ("scan.pdf", b"%PDF", "pdf", ""),
    ("none.txt", None, "txt", ""), ("empty.", b"x", "", "x"),
]


def test_file_text(spark):
    df = spark.createDataFrame([(i, n, c) for i, (n, c, _, _) in enumerate(FILES)], "i INT, name STRING, content BINARY")
    out = documents.extract_text(df)
    assert [(r.ext, r.text) for r in out.orderBy("i").collect()] == [(e, t) for _, _, e, t in FILES]
    assert documents.indexable(out).count() == sum(bool(t) for *_, t in FILES)


def test_uploads_of_every_kind(spark, tmp_path):
    """No document is given up for the odd files: those come beside it, and only they have no row."""
    docs = {i: f"téxt {i}" for i in range(1, 386)}
    df = spark.createDataFrame([*docs.items(), (390, ""), (391, None)], "doc_id BIGINT, text STRING")
    df.withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(f"{tmp_path}/documents.parquet")
    uploads = texts._uploads(spark, str(tmp_path)).collect()
    assert sum(u.name == "scan.PDF" for u in uploads) == 55
    assert sum(u.name != "scan.PDF" and u.content == b"" for u in uploads) == 35
    assert sum((u.content or b"").endswith(b"\xff\xfe") for u in uploads) == 78
    names = ("Notes.TXT", "read.me.md", "data.csv", "plain")
    rows = texts.QUERIES["src_files_text"](spark, str(tmp_path)).collect()
    assert sorted((int(r.id), r.name, r.ext, r.text) for r in rows) == [
        (i, names[i % 4], names[i % 4].lower().split(".")[-1], t) for i, t in docs.items()]


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.TXT").write_bytes(b"one")
    (tmp_path / "b.docx").write_bytes(DOCX)
    rows = documents.extract_text(documents.read_files(spark, str(tmp_path))).select("name", "text").collect()
    assert {(r.name, r.text) for r in rows} == {("a.TXT", "one"), ("b.docx", "One line\n\nTwo\tx\n")}


@pytest.mark.parametrize("html, title, content", [
    ("<title>A &amp; B</title><p>one</p><p>two <b>bold</b></p>", "A & B", "one two bold"),
    ('<script>var t="</p><p>no</p>";</script><p>yes</p>', "", "yes"),
    ("<p>open<p>inner</p> tail</p>after", "", "openinner tail inner"),
    ("<div><p>cut</div>out<p>x<br>y</p>", "", "cut xy"),
    ("<p>a<!-- hidden --><style>p{}</style>b</p></p>", "", "ab"),
    ("no markup", "", ""),
    ("<title>first</title><title>second</title><p></p><p>z", "first", " z"),
])
def test_page_text(html, title, content):
    assert documents.page_text(html) == (title, content)
