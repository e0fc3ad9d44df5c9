"""Quality rules against plain Python, the classifier on held-out labels, and the odd cases of both."""

import re

import duckdb
import numpy as np
import plain
from pyspark.sql import functions as F

import corpus_pipeline

from abacist.llm import byte_net, divergence

SF_DIR = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "one", "a b c a b c a b c", "x x x x", "same line\nsame line\n\n\nsame line", "é ß 漢字 # * $ | < > & %", "The the. " * 40,
       "word " * 3000, "\x0b\x0ca b\rc"]


def odd(spark):
    rows = [(i, t, lang, "clash") for i, t in enumerate(ODD) for lang in ("en", None, "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality string")


def test_base_rules(spark):
    docs = odd(spark)
    out = divergence.quality_rules(docs)
    assert out.columns == [*docs.columns, "_quality"] and out.count() == docs.count()
    for row in out.collect():
        want = plain.base_rules(row.text)
        assert {k: row._quality[k] for k in want} == want, row.text
        assert not (row._quality.kept and row._quality.base_failed)


def test_rules_of_nothing(spark):
    assert divergence.quality_rules(odd(spark).where("false")).collect() == []


def test_junk_is_far_and_prose_is_near(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id")
    rows = divergence.quality_rules(docs.withColumnRenamed("quality", "label")).where("not quality.base_failed").groupBy("label").agg(
        F.avg(F.col("quality.kept").cast("int")).alias("kept")).collect()
    kept = {r.label: r.kept for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.3


def _prose(seed, letters, common=(), n=200):
    """Words of random letters, every fourth one a common word, and one of some digits."""
    draw = np.random.default_rng(seed)
    return "7" * (seed % 30) + " " + " ".join(common[i // 4 % len(common)] if common and i % 4 == 0 else "".join(draw.choice(list(letters), 6)) for i in range(n))


def test_languages_are_judged_by_their_own(spark):
    kinds = {"ru": "абвгдежзиклмнопрст", "zh": "天地玄黃宇宙洪荒日月盈昃辰宿列張"}
    rows = [(100 * k + i, _prose(100 * k + i, letters), lang) for k, (lang, letters) in enumerate(kinds.items()) for i in range(30)]
    rows += [(900, _prose(900, kinds["ru"]), "zh"), (901, _prose(901, kinds["ru"]), "few"), (902, _prose(902, kinds["zh"]), "few"),
             (903, _prose(903, kinds["ru"]), None), (904, _prose(904, kinds["zh"]), " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.quality for r in divergence.quality_rules(docs).collect()}
    assert {i for i, q in got.items() if not q.kept} == {900}
    assert {i for i, q in got.items() if q.class_distance is None} == {901, 902, 903, 904}


def test_common_words_come_from_the_documents(spark):
    common, letters = ("og", "ikke", "det", "som", "på", "til", "av", "er", "jeg", "han", "ved", "men"), "abdefghijklmnoprstuv"
    rows = [(i, _prose(i, letters, common), "no") for i in range(30)]
    rows += [(100 + i, _prose(100, letters), "no") for i in range(40)]  # copies hold more rows than any common word
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    listed = {r.language: set(r.listed) for r in divergence.common_words(docs).collect()}
    assert listed == {"no": set(common)}
    got = {r.doc_id: r.quality for r in divergence.quality_rules(docs).collect()}
    assert {i for i, q in got.items() if q.kept} == set(range(30))
    assert all(q.common_distance > divergence.MAX_COMMON_DISTANCE for i, q in got.items() if i >= 100)


def test_twin_follows_the_code_in_any_language(spark, tmp_path):
    """A language with listed words, two with words from the corpus, a rare one, blank ones, copies and foreign texts."""
    common = {"no": ("og", "ikke", "det", "som", "på", "til", "av", "er", "jeg", "han", "ved", "men", "så"), "pt": ("não", "uma", "os", "ao")}
    letters = {"no": "abdefghijklmnoprstuv", "pt": "aceilmnoprst", "ru": "абвгдежзиклмнопрст"}
    rows = [(100 * k + i, _prose(100 * k + i, letters[lang], common.get(lang, ()), 150 + 3 * i), lang) for k, lang in enumerate(letters) for i in range(25)]
    rows += [(1000 + i, _prose(5, letters["no"], (), 200), "no") for i in range(30)] + [(1100 + i, _prose(900 + i, letters["ru"], (), 200), lang) for i, lang in
                                                                                          enumerate(["no", "pt", "rare", None, " ", "en", "ru"])]
    rows += [(1200 + i, _prose(i, "etaoinshrdlu", divergence.COMMON["en"], 200), "en") for i in range(12)] + [(1300, None, "no"), (1301, "", "pt"), (1302, "é " * 130, "pt")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(divergence.ORACLES["op6_quality_rules"])
    names = [c[0] for c in result.description]
    want = sorted(result.fetchall())
    assert sorted(tuple(r) for r in divergence.op6_quality_rules(spark, str(tmp_path)).select(*names).collect()) == want
    kept = {r[0]: r[-1] for r in want}
    assert sum(kept.values()) > 60 and not kept[1000] and not kept[1100] and kept[1102]


def test_rules_are_evaluated_once_in_the_pipeline(spark):
    """A filter on the verdict repeats nothing of what the verdict is made from."""
    def counts(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return len(re.findall(r"split\(", plan)), len(re.findall("regexp_replace", plan))

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plain_rules, stage = counts(divergence.quality_rules(docs)), counts(corpus_pipeline.quality_rules(spark, docs, SF_DIR))
    assert stage == plain_rules == (2, len(divergence.CLASSES))


def test_common_words_are_native(spark):
    plan = divergence.op6_quality_rules(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_held_out_documents(spark):
    rows = byte_net.op7_quality_classifier(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_of_odd_texts(spark):
    model = byte_net.train([b"good prose " * 9, b"JUNK!! " * 9] * 20, np.array([1, 0] * 20), 0.5)
    out = byte_net.classify(odd(spark).withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == 3 * len(ODD) and all(0 <= r._score <= 1 for r in out)
    assert byte_net.classify(odd(spark).where("false"), model).collect() == []
    assert model.score([b"more good prose " * 9])[0] > 0.5 > model.score([b"MORE JUNK!! " * 9])[0]


def test_every_part_of_a_text_counts():
    model = byte_net.train([b"good prose " * 9, b"JUNK!! " * 9] * 20, np.array([1, 0] * 20), 0.5)
    text = b"good prose " * 2000
    for at in (0, 7_000, len(text) - 300):
        assert model.score([text[:at] + b"JUNK!! " * 40 + text[at:]])[0] < model.score([text])[0]
    batch = model.score([text, b"", b"JUNK!! " * 9, text])
    assert np.allclose(batch, [model.score([x])[0] for x in (text, b"", b"JUNK!! " * 9, text)])


def plain_score(model, text):
    """The network position by position: padded as its layout says, chunks of CHUNK blocks every STEP, maxima, means."""
    size, width = byte_net.BLOCK, byte_net.WIDTH
    blocks = -(-(len(text) + width - 1) // size)
    data = text + bytes([byte_net.PAD]) * (blocks * size - len(text))
    answers = []
    for i in range(blocks * size - width + 1):
        answers.append((i, sum(model.filters[j][data[i + j]].astype(np.float64) for j in range(width))))
    starts = [0]
    while starts[-1] + byte_net.CHUNK < blocks:
        starts.append(starts[-1] + byte_net.STEP)
    pooled = []
    for first in starts:
        last = min(first + byte_net.CHUNK, blocks)
        pooled.append(np.tanh(np.max([x for i, x in answers if first * size <= i < last * size], axis=0) + model.bias))
    given = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    return 1 / (1 + np.exp(-(given @ model.weights + model.offset)))


def test_scores_are_those_of_a_plain_loop():
    model = byte_net.train([b"good prose " * 9, b"JUNK!! " * 9] * 20, np.array([1, 0] * 20), 0.5)
    draw = np.random.default_rng(2)
    size = byte_net.BLOCK
    lengths = [0, 1, size - 1, size, size + 1, size * byte_net.CHUNK, size * byte_net.CHUNK + 1, size * (byte_net.CHUNK + byte_net.STEP), size * 40 + 7]
    texts = [bytes(draw.integers(32, 127, n).astype(np.uint8)) for n in lengths]
    assert np.allclose(model.score(texts), [plain_score(model, x) for x in texts], atol=1e-4)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    scores = {r.score for r in byte_net.classify(docs, byte_net.fit(docs, labels)).collect()}
    assert scores == {0.5}
    one_kind = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert len(byte_net.classify(docs, byte_net.fit(docs, one_kind)).collect()) == 2
