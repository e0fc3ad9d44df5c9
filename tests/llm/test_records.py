"""Merkle manifests, personal data and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from abacist.llm import merkle, personal_data, spellings

LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """The last node, and for every first one its siblings left and right level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            run, j = runs[i // 16], i % 16
            ways[k].append(("".join(run[:j]), "".join(run[j + 1:])))
        nodes, at = [sha("".join(r)) for r in runs], [i // 16 for i in at]
    return nodes[0], ways


def plain_manifest(rows):
    def leaf(row, text):
        values = [row[0], row[3], row[2], row[4], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for row in rows:
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None
        groups[row[3]].append((row[0], leaf(row, row[1]), leaf(row, row[1].translate(LOWER) if changed else row[1])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for some in groups.values():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ends = {s: climb([r[1] for r in groups[s]]) for s in names}
    root, upper = climb([ends[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (doc_id, own, shown), way in zip(groups[s], ends[s][1]):
            folded = shown
            for a, b in way + upper[k]:
                folded = sha(a + folded + b)
            out.append((doc_id, own, ends[s][0], root, sha("".join(a + b for a, b in way + upper[k])), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [700, 3, 256, 257], [2] * 300])
def test_manifest(spark, monkeypatch, tmp_path, sizes):
    rng = random.Random(len(sizes))
    rows = []
    for k, size in enumerate(sizes):
        source = None if k == 1 else "" if k == 2 else f"sß{k * 7 % 1000}"
        for _ in range(size):
            rows.append((rng.choice([rng.randrange(100_000), rng.randrange(50)]), rng.choice([None, "", "Some TEXT É", "low", "x" * 3000]),
                         rng.choice([None, "en"]), source, rng.choice([None, 7])))
    rows += [rows[0]] * 3 + [(None, "A", None, rows[0][3], None)] * 2
    frame = spark.createDataFrame([(*r, "z", "y") for r in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long, digest string, root string")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_a_very_long_text(spark, tmp_path):
    frame = spark.createDataFrame([(10, "Ä B" * 700_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "a/documents.parquet"))
    frame.where("false").write.parquet(str(tmp_path / "b/documents.parquet"))
    assert [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path / "a")).collect()] == plain_manifest([tuple(r) for r in frame.collect()])
    assert merkle.op11_merkle_manifest(spark, str(tmp_path / "b")).collect() == []


def test_queue_never_holds_more_than_a_run_a_level(monkeypatch):
    most = 0

    class Watched(merkle.Queue):
        def label(self, level, place):
            nonlocal most
            most = max(most, len(self.heap))
            return super().label(level, place)

    monkeypatch.setattr(merkle, "Queue", Watched)
    top, _ = merkle.sweep_up([sha(str(i)) for i in range(5000)], 4)
    assert top == climb([sha(str(i)) for i in range(5000)])[0] and most <= 4 * merkle.FAN


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            twice = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and twice % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("a@.0 1+-(é9", max_size=60), st.text("4 2-1.0+", max_size=60), st.text("@a.", max_size=30)))
def test_base_spans_are_those_of_the_patterns(text):
    found = [s[:3] for s in personal_data.find(text)]
    assert [s for s in found if s[0] in personal_data.BASE] == plain_base(text)
    spans = sorted((a, b) for k, a, b in found if k not in personal_data.BASE)
    base = [(a, b) for k, a, b in found if k in personal_data.BASE]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and not any(a < d and c < b for a, b in spans for c, d in base)


FOUND = [
    ("IBAN: DE89 3704 0044 0532 0130 00 IS", [("iban", 6, 33)]), ("DE89370400440532013000", [("iban", 0, 22)]), ("DE88 3704 0044 0532 0130 00", []),
    ("my ssn 123-45-6789.", [("ssn", 7, 18)]), ("123-45-6789", []), ("ssn 666-45-6789", []), ("part serial ssn 123-45-6789", []),
    ("Visa card 4111.1111.1111.1111", [("card_other", 10, 29)]), ("card 4111 1111 1111 1111 12", [("card_other", 5, 24)]), ("4111.1111.1111.1111", []),
    ("order card 4111.1111.1111.1111", []), ("Tel. (030) 1234567", [("phone_national", 5, 18)]), ("(030) 1234567", []),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', [("secret", 9, 49)]), ("sha 04dbebab91ab85687d33eeaaf9ac699e1188f962", []),
    ("token aaaaaaaaaaaaaaaaaaaaaaa1", []), ("card 4111 1111 1111 1111", [("card", 5, 24)]), (None, []), ("", []), ("é@b.c", []),
]


@pytest.mark.parametrize(("text", "spans"), FOUND)
def test_further_spans_and_their_context(text, spans):
    assert [s[:3] for s in personal_data.find(text or "")] == spans


def test_checksums():
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")
    assert personal_data.mod97("GB82WEST12345698765432") and not personal_data.mod97("GB82WEST12345698765433")


def test_personal_data_of_rows(spark, tmp_path):
    def long(n):
        return "a" * n + " " + "1" * n + " +1" + " " * n + "x@" * n + " me@x.org " + "1." * (4 * n) + "+1 (017) 555-7713"

    assert [s[:3] for s in personal_data.find(long(300)) if s[0] in personal_data.BASE] == plain_base(long(300))
    kinds = Counter(s[0] for s in personal_data.find(long(20_000)))  # what a quadratic scan would never end
    assert kinds == {"email": 1, "ip": 20_000, "phone": 1}
    rows = [(1, "Mail ä me@x.org, 1.2.3.4"), (1, "Mail ä me@x.org, 1.2.3.4"), (2, None), (3, ""), (None, "+1 (017) 555-7713"), (4, long(100))]
    spark.createDataFrame([(*r, "e", "f") for r in rows], "doc_id long, text string, spans string, found string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in personal_data.op12_personal_data(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, t in rows:
        base, n = plain_base(t), Counter(k for k, _, _ in plain_base(t))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *(n[k] for k in PLAIN), sha(text), text))
    assert got == sorted(want, key=repr)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.personal_data(none).collect() == []
    assert personal_data.redact("a me@x.org b 1.2.3.4") == "a <email> b <ip>"


@pytest.mark.parametrize("sf", ["0.001"])
def test_personal_data_of_the_tables(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()}
    for r in personal_data.op12_personal_data(spark, f"/root/testdata/sf{sf}").collect():
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)) and r.n_email == sum(k == "email" for k, _, _ in base)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_spellings(rows, shortest=6, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    close = {w: [v for v in n if v != w and near(v, w)] for w in n}
    form = {}
    for w, some in close.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize(("cell", "leaf"), [(2048, 128), (16, 4)])
def test_spellings(spark, monkeypatch, cell, leaf):
    monkeypatch.setattr(spellings, "CELL", cell)
    monkeypatch.setattr(spellings, "LEAF", leaf)
    monkeypatch.setattr(spellings, "TOGETHER", 50)
    rng = random.Random(cell)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(250)] + ["straße", "strasse", "ÀÿÞöäü", "q" * 300, "q" * 301, "q" * 70_000]
    rows = []
    for i in range(400):
        some = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        some = [w[:2] + w[3:] if rng.random() < 0.1 else w.upper() if rng.random() < 0.1 and w.isascii() else w for w in some]
        rows.append((i if i % 9 else None, rng.choice([" ", "\n", "1", "-"]).join(some) if i % 23 else rng.choice([None, ""])))
    rows += [(1, "banana " * 200 + "bananas " * 30 + "bananaz " * 6 + "bananazz " * 6)] * 2 + [(5, "q" * 70_000 + " x " + "q" * 70_000)] * 2
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n long, form string").repartition(5)
    got = spellings.spelling_variants(docs)
    assert set(got.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_spellings(rows)
    assert spellings.spelling_variants(docs.where("false")).collect() == []


def test_cells_reach_every_near_word():
    rng = random.Random(3)
    points = sorted({"".join(rng.choice("abcdeüé") for _ in range(7)) for _ in range(900)})
    for size in (6, 7):
        queries = sorted({"".join(rng.choice("abcdeüé") for _ in range(size)) for _ in range(700)})
        want = {(q, p) for q in queries for p in points if near(q, p)}
        vectors = spellings.vectors(points)
        tree = spellings.upper_tree(vectors, 40)
        own = {i: cell for cell, rows in spellings.reached(tree, vectors, 0, 0) for i in rows}
        assert len(own) == len(points) and len(set(own.values())) > 10
        got, looked = [], 0
        for cell, rows in spellings.reached(tree, spellings.vectors(queries), 1, 1 if size == 7 else 0):
            inside, asked = [points[i] for i in own if own[i] == cell], [queries[i] for i in rows]
            looked += len(inside) * len(asked)
            got += [(asked[i], inside[j]) for a, b in spellings.near_in_cell(inside, asked) for i, j in zip(a, b)]
        assert sorted(got) == sorted(want) and len(want) > 20 and looked < len(points) * len(queries)


def test_letter_counts():
    assert spellings.vectors(["abbÿ"]).sum() == 4 and spellings.vectors(["abbÿ"])[0][[0, 1, 89]].tolist() == [1, 2, 1]
    assert spellings.one_edit(["abc", "abc", "abc"], ["abcd", "xabc", "abdc"]).tolist() == [True, True, True]
    assert spellings.one_edit(["abc", "abc"], ["acbd", "cabd"]).tolist() == [False, False]
    assert spellings.cut(np.array([[1, 2], [1, 2]])) is None
