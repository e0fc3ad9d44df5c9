"""Every stage of the pipeline against plain Python, on its own input."""

import plain
import sentencepiece

import corpus_pipeline
from abacist.llm import byte_net, divergence

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        texts = {r.doc_id: r.text for r in before}
        kept = {r.doc_id for r in after.collect()}
        if name == "quality_rules":
            base = {i for i, t in texts.items() if not plain.base_rules(t)["base_failed"]}
            verdict = {r.doc_id for r in divergence.quality_rules(docs).where("quality.kept").collect()}
            assert kept == verdict <= base and len(kept) > 0.9 * len(base)
        elif name == "quality_classifier":
            model = byte_net.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            assert kept == {i for i, t in texts.items() if model.score([t.encode()])[0] >= 0.3}
        elif name == "near_duplicates":
            groups = plain.components({i: plain.shingles(t, 5) for i, t in texts.items()}, 8, 10)
            assert kept == set(groups.values())
        elif name == "decontamination":
            assert kept == {i for i, t in texts.items() if not any(plain.contained(t, x) for x in items)}
        else:
            import public_tokenizers

            processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {r.doc_id: r.ids for r in after.collect()} == {i: processor.encode(t) for i, t in texts.items()}
        if name != "pieces":
            assert after.columns == columns and {r.doc_id: r.text for r in after.collect()} == {i: texts[i] for i in kept}
        docs = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()} == kept


def test_stages_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, "word " * 80, "xx", None, 400, "y")],
                                 "doc_id long, text string, lang string, source string, n_chars long, ids string")
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF_DIR)
            assert name == "pieces" or out.columns == docs.columns
            assert out.count() <= frame.count()
