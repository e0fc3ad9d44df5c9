"""Token-id files: flat unsigned integers plus 64-bit document offsets, read back through a memory map.

A folder holds, for every shard ``k``, ``k.ids`` (ids of all documents in a row, ``<u2`` or ``<u4`` by the size of the
vocabulary), ``k.off`` (``<i8``, one offset more than documents, counted from the shard's first id) and ``k.doc``
(``<i8``, the documents' ids). Shards follow each other in ascending document order, so the position of an id in the whole
corpus is the shard's base, a prefix sum over the shards before it, plus the offset in the shard.

Defined results: a null or empty text has the end id only; a null doc_id sorts first and reads back as null; rows with equal
doc_id are kept and sort by text; an empty table gives no shards with rows and an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.arrow import slices
from abacist.llm.pieces import PieceTable, by_text
from abacist.session import scratch_path

SHARDS = "shard int, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of distinct pieces that go to the tokenizer as one text, about so many.
JOINED = 2048
#: Stands for a null doc_id in a file.
NO_ID = np.iinfo(np.int64).min

#: Texts in which a cut at every space and around every line feed might not be one of the tokenizer's own cuts: other white
#: space, white space in a row, the cut mark itself, or the beginning of a special token. These go to the tokenizer whole.
IRREGULAR = (r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
             r"|[ \n][ \n]|\x00|<\|")


def byte_level_pieces(texts: pa.Array) -> pa.ListArray:
    """Words with the space before them, and line feeds; byte-level tokenizers never join over these cuts."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
    return pc.split_pattern(marked, "\x00")


class ByteLevel:
    """The tokenizers library over lists of pieces.

    Words with their space go to it joined; which ids are whose is seen from the bytes that the ids stand for. Words without a
    space are put after a line feed, whose id is dropped again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a character of a byte-level token is a byte

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encode([text])[0], np.uint32)

    def _joined(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, text = pieces.buffers()
        offsets = np.frombuffer(offsets, np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
        some = np.unique(np.searchsorted(offsets, np.arange(offsets[0], offsets[-1] + JOINED, JOINED)).clip(max=len(pieces)))
        texts = [text[a:b].to_pybytes().decode() for a, b in zip(offsets[some].tolist(), offsets[some[1:]].tolist())]
        ids = np.concatenate([np.array(x, np.uint32) for x in self.encode(texts)])
        ends, cuts = np.cumsum(self.n_bytes[ids]), offsets[1:] - offsets[0]
        at = np.searchsorted(ends, cuts)
        if not np.array_equal(ends[at], cuts):
            raise RuntimeError("the tokenizer joined two pieces")
        return np.diff(np.concatenate([[0], at + 1])), ids

    def __call__(self, pieces: list[str] | pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pieces = pieces if isinstance(pieces, pa.StringArray) else pa.array(pieces, pa.string())
        counts, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        flat, size = [], 0

        def put(some, n: np.ndarray, ids: np.ndarray) -> None:
            nonlocal size
            counts[some], starts[some] = n, size + np.cumsum(n) - n
            flat.append(ids)
            size += len(ids)

        alone = pc.is_in(pieces, pa.array(["", " ", "\n"])).to_numpy(zero_copy_only=False)
        first = pc.utf8_slice_codeunits(pieces, 0, 1)
        for i in np.flatnonzero(alone):
            ids = self.whole(pieces[i].as_py())
            put([i], np.array([len(ids)]), ids)
        spaced = pc.equal(first, " ").to_numpy(zero_copy_only=False) & ~alone
        if spaced.any():
            put(spaced, *self._joined(pieces.filter(pa.array(spaced))))
        bare = ~pc.is_in(first, pa.array(["", " ", "\n"])).to_numpy(zero_copy_only=False)
        if bare.any():
            n, ids = self._joined(pc.binary_join_element_wise("\n", pieces.filter(pa.array(bare)), ""))
            put(bare, n - 1, np.delete(ids, np.cumsum(n) - n))
        return counts, starts, np.concatenate(flat)


class ArrowTable(PieceTable):
    """A table whose pieces stay in Arrow: nothing is done for each of them in Python."""

    def _empty(self) -> None:
        super()._empty()
        self.known = pa.array([], pa.string())

    def look_up(self, pieces: pa.Array) -> np.ndarray:
        if len(self.known) > self.most:
            self._empty()
        coded = pieces.dictionary_encode()
        found = pc.index_in(coded.dictionary, self.known)
        fresh = coded.dictionary.filter(pc.is_null(found))
        slots = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        slots[slots < 0] = len(self.known) + np.arange(len(fresh))
        if len(fresh):
            self._add(fresh)
            self.known = pa.concat_arrays([self.known, fresh])
        return slots[coded.indices.to_numpy(zero_copy_only=False)]


def encode_texts(texts: pa.Array, table: PieceTable, tokenizer: ByteLevel) -> Iterator[np.ndarray]:
    """The ids of every text in turn."""
    texts = pc.fill_null(texts, "")
    irregular = pc.match_substring_regex(texts, IRREGULAR)
    lists = byte_level_pieces(texts.filter(pc.invert(irregular)))
    slots = table.look_up(lists.flatten())
    bounds = np.concatenate([[0], np.cumsum(by_text(lists, table.counts[slots]))])
    ids, at = table.gather(slots), 0
    for i, odd in enumerate(irregular.to_pylist()):
        if odd:
            yield tokenizer.whole(texts[i].as_py())
        else:
            yield ids[bounds[at]:bounds[at + 1]]
            at += 1


def _open(uri: str, mode: str):
    """A stream of a file on any store that Arrow knows; a plain path or a file: URI is a file of a mounted folder."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)
    return store, path, store.open_output_stream(path) if mode == "w" else store.open_input_file(path)


def _put(uri: str, parts) -> None:
    """Written aside and renamed, so that a second attempt of a task or a lost executor leaves whole files only."""
    store, path, out = _open(f"{uri}.{uuid.uuid4().hex}", "w")
    with out:
        for part in parts:
            out.write(part)
    store.move(path, path.rsplit(".", 1)[0])


def _mapped(uri: str, kind: str) -> np.ndarray:
    """The file as an array: a memory map where the folder is mounted, read as a whole shard elsewhere."""
    if re.match(r"(?!file:)\w+:/", uri):
        store, path, source = _open(uri, "r")
        with source:
            return np.frombuffer(source.read(), kind)
    path = re.sub(r"^file:/+", "/", uri)
    return np.memmap(path, kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Encode the texts of ``docs`` (doc_id, text) into ``folder``; a row for each shard: shard, n_docs, n_ids, base.

    Runs Spark jobs at once: the range partitioning samples doc_id, and the shards' bases need every shard's count. What the
    driver holds is one row for each shard.
    """
    spark = docs.sparkSession
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    if folder.startswith("/"):
        os.makedirs(folder, exist_ok=True)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = ByteLevel(tokenizer)
        table = ArrowTable(library)
        shard, doc_ids, lengths = TaskContext.get().partitionId(), [], []

        def chunks():
            for batch in slices(batches):
                doc_ids.extend(NO_ID if x is None else x for x in batch.column("doc_id").to_pylist())
                for ids in encode_texts(batch.column("text"), table, library):
                    lengths.append(len(ids) + 1)
                    yield np.append(ids, end_id).astype(kind).tobytes()

        _put(f"{folder}/{shard}.ids", chunks())
        _put(f"{folder}/{shard}.off", [np.cumsum([0, *lengths], dtype="<i8").tobytes()])
        _put(f"{folder}/{shard}.doc", [np.array(doc_ids, "<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [len(lengths)],
                                          "n_ids": [sum(lengths)]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .repartitionByRange(F.asc_nulls_first("doc_id")) \
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    shards, base, rows = ordered.mapInArrow(encode, SHARDS).collect(), 0, []
    for shard in sorted(shards, key=lambda x: x.shard):
        rows.append((shard.shard, shard.n_docs, shard.n_ids, base))
        base += shard.n_ids
    return spark.createDataFrame(rows, SHARDS + ", base long")


def read(shards: DataFrame, folder: str, vocabulary: int) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens (with the end id) and the checksum of its ids."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                ids, off, doc = (_mapped(f"{folder}/{shard}.{x}", k) for x, k in (("ids", kind), ("off", "<i8"), ("doc", "<i8")))
                for at in range(0, len(doc), 10_000):
                    name, ends = np.asarray(doc[at:at + 10_000]), np.asarray(off[at:at + 10_001])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name, pa.int64(), mask=name == NO_ID), pa.array(base + ends[:-1]),
                         pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, shards.count())
    return shards.repartition(parts, "shard").mapInArrow(load, ROWS)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to ``folder`` (a fresh one below the shared folder if none is given) and read it back, row by document."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read(write(docs, folder, tokenizer, end_id, vocabulary), folder, vocabulary)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, vocabulary=50_257)


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
