"""Token counts: texts are cut at safe boundaries, distinct pieces encoded in batches of equal bytes, and only lengths returned.

White space is a safe boundary of a tokenizer whose normaliser and splitter treat it as such (the operator's caller vouches for
that): no token spans it and it makes none. Defined results: a null or empty text, and one of white space only, has 0 tokens;
repeated rows and null ids are counted like any others; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.arrow import slices
from abacist.llm.pieces import PieceTable, by_text, in_batches

ROWS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes of distinct pieces that go to the tokenizer at once.
BATCH_BYTES = 1 << 16


class Lengths:
    """Number of tokens by piece. Pieces go to the library joined by a special token, which always stands alone."""

    def __init__(self, path: str, separator: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.separator = Tokenizer.from_file(path), separator
        self.mark = self.tokenizer.token_to_id(separator)
        if self.mark is None:
            raise ValueError(f"{separator} is no special token of this tokenizer")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts, at = [], 0
        for i in [*(i for i, p in enumerate(pieces) if self.separator in p), len(pieces)]:
            words = pieces[at:i]
            for a, b in in_batches(words, BATCH_BYTES):
                ids = self.whole(self.separator.join(words[a:b]))
                parts = np.diff(np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])) - 1
                if len(parts) != b - a:
                    raise RuntimeError("the separator did not stand alone")
                counts.append(parts)
            if i < len(pieces):
                counts.append([len(self.whole(pieces[i]))])
            at = i + 1
        return np.concatenate(counts).astype(np.int64), np.zeros(len(pieces), np.int64), np.zeros(0, np.uint32)


def token_counts(docs: DataFrame, tokenizer: str, separator: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(Lengths(tokenizer, separator))
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            lists = pc.ascii_split_whitespace(texts)
            slots = table.look_up(lists.flatten())
            totals = by_text(lists, table.counts[slots])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(totals, pa.int64()),
                 pa.array(totals > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(count, ROWS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), "<|startoftext|>", limit=2048)


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
