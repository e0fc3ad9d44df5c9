"""Token files, token counts and sentence pieces against the libraries, on odd texts and on whole tables."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from abacist.llm import sentence_pieces, token_counts, token_files
from abacist.llm.pieces import PieceTable

SF_DIR = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n", "a  b", "x \n y\n\nz", "  lead", "trail ", "\n\nq", "foo <|endoftext|> bar<|startoftext|>x", "tab\tq r s  \n", "\nb",
       "Σίσυφος ΣΑΣ é ́x", "it's we'll DON'T 123 45", " \nfoo", "日本語 テキスト", "\x1cq", "\u0085n   k", "a\x00b", "x" * 3000, "word " * 5000, "q\n", "🙂 é"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (5, "x \n y\n\nz", "x"), (5, "same id", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def library(name, texts):
    return [x.ids for x in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files_read_back(spark, odd):
    got = token_files.token_files(odd, public_tokenizers.path("byte_bpe_50k.json"), 2, 50257).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start = 0
    for mine, row, ids in zip(sorted(got, key=lambda r: r.start), rows, library("byte_bpe_50k.json", [r.text for r in rows])):
        ids = np.array([*ids, 2], "<u4")
        assert (mine.doc_id, mine.start, mine.n_tokens, mine.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_op4_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in token_files.op4_token_files(spark, SF_DIR).collect()}
    start = 0
    for row, ids in zip(docs, library("byte_bpe_50k.json", [r.text for r in docs])):
        ids = np.array([*ids, 2], "<u4")
        assert tuple(got[row.doc_id]) == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_token_files_of_nothing(spark, odd):
    assert token_files.token_files(odd.where("false"), public_tokenizers.path("byte_bpe_50k.json"), 2, 50257).collect() == []


def test_wide_ids(spark, odd):
    few = odd.where("doc_id < 4")
    narrow, wide = (token_files.token_files(few, public_tokenizers.path("byte_bpe_50k.json"), 2, n).collect() for n in (50257, 70000))
    assert sorted(narrow) == sorted(wide)


def test_token_counts(spark, odd):
    got = token_counts.token_counts(odd, public_tokenizers.path("word_bpe_49k.json"), "<|startoftext|>", 2048).collect()
    rows = odd.collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(ids), len(ids) > 2048)
            for r, ids in zip(rows, library("word_bpe_49k.json", [r.text for r in rows]))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_op5_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in token_counts.op5_token_counts(spark, SF_DIR).collect()}
    for row, ids in zip(docs, library("word_bpe_49k.json", [r.text for r in docs])):
        assert got[row.doc_id] == (row.doc_id, len(row.text.encode()), len(ids), len(ids) > 2048)


def test_table_starts_anew():
    table = PieceTable(token_files.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), most=3)
    for texts in (["a b c d e"], ["f g h"], ["a b c"]):
        lists = token_files.byte_level_pieces(pa.array(texts))
        assert table.gather(table.look_up(lists.flatten())).tolist() == library("byte_bpe_50k.json", texts)[0]


def test_pieces_stay_in_arrow():
    """No piece becomes a Python object on its way to the library; odd ones and a table that starts anew included."""
    seen, library_of = [], token_files.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))

    def encode(pieces):
        seen.append(pieces)
        return library_of(pieces)

    table = token_files.ArrowTable(encode, most=30)
    for texts in (["a b c d e", "", " ", "é\n\nΣίσυφος 日本語 it's 12,5 q"], ["x" * 3000 + " y", "a b"], [f"w{i} v{i}" for i in range(900)], ["a b c", "d"]):
        lists = token_files.byte_level_pieces(pa.array(texts))
        assert table.gather(table.look_up(lists.flatten())).tolist() == [i for x in library("byte_bpe_50k.json", texts) for i in x]
    assert len(seen) >= 4 and all(isinstance(x, pa.StringArray) for x in seen)
    assert not table.slots


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_are_the_librarys_and_come_back(spark, odd):
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentence_pieces.encode(odd, PIECES).collect()
    for row in rows:
        assert row.ids == processor.encode(row.text or ""), row.text
    back = sentence_pieces.decode(sentence_pieces.encode(odd, PIECES).withColumnRenamed("text", "given"), PIECES)
    assert back.where(F.col("text") != F.coalesce("given", F.lit(""))).count() == 0
    assert "n_tokens" in back.columns and back.count() == len(rows)


def test_op3_whole_table(spark):
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = sentence_pieces.op3_pieces(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert row.ids == processor.encode(docs[row.doc_id]) and row.round_trip and row.n_tokens == len(row.ids)


def test_decode_of_broken_ids():
    model = sentence_pieces.PieceModel(PIECES)
    assert model.decode(np.array([1, 99999, -4, 3 + 0xFF]), np.array([3, 1, 0])) == ["", "�", ""]


def test_unigram_search_is_the_best_way():
    model = sentence_pieces.PieceModel(PIECES)
    model.kind = sentence_pieces.UNIGRAM
    scores = {p: s for p, s, kind in model.pieces if kind == sentence_pieces.NORMAL}

    def best(word):
        reach = [0.0] + [None] * len(word)
        for end in range(1, len(word) + 1):
            reach[end] = max(reach[a] + scores.get(word[a:end], model.unknown_score if end - a == 1 else float("-inf"))
                             for a in range(max(0, end - model.longest), end))
        return reach[-1]

    some = [" the", " thorough", "anderson", " łódź", " x", "  y", " internationalisation", "\n", " the"]
    counts, starts, ids = model.encode_words(some)
    for word, n, at in zip(some, counts, starts):
        word = word.replace(" ", sentence_pieces.MARK)
        spelt = [int(i) for i in ids[at:at + n]]
        if all(model.pieces[i][2] == sentence_pieces.NORMAL for i in spelt):
            assert "".join(model.pieces[i][0] for i in spelt) == word
            assert sum(model.pieces[i][1] for i in spelt) == pytest.approx(best(word))
