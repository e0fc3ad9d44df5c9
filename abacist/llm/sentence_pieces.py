"""SentencePiece encoding and decoding: batched Viterbi search in numpy over the pieces of a model file.

Words of equal length advance together: for every end position, hashes of all substrings that end there probe the sorted keys of
the pieces, and vectorised maxima keep the best way there and the piece that reached it. Every distinct word is searched once
for each task (see ``pieces``); a text's ids are its words' in a row, as no piece crosses the beginning of a word.

What the maxima compare depends on how the model was made, so that ids are the library's. In a unigram model it is the sum of
scores (of equal ones, the longest last piece wins; a character that is no piece costs the lowest score less 10). A model made by
merging reads a text by repeatedly merging the best neighbours. There a piece may follow another only if merging their
characters would not have crossed the border between them, which undoing the two pieces' merges from the last one tells; exactly
one way through a word has such borders only, and the search over prefixes finds it. Characters that are no piece become their
UTF-8 bytes.

Defined results: a null or empty text has no ids and decodes to an empty one; the space mark U+2581 in a text is a space; ids out of
range or of control pieces decode to nothing, broken bytes to U+FFFD; repeated rows encode equally; an empty table gives no rows;
other columns are kept, and new ones take underscores if their name is taken.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.arrow import slices
from abacist.llm.columns import fresh
from abacist.llm.pieces import PieceTable, by_text

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
#: Kinds of models.
UNIGRAM, MERGES = 1, 2
HEAD_BITS = 20
#: Stands for a character that is no piece.
NO_PIECE = 0xFFFF
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: Cells of a batch of equally long words.
CELLS = 1 << 17
#: Bytes of text that are encoded or decoded at once; the arrays meanwhile take some ten times as much.
TEXT_BYTES = 2 << 20
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at:at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and kinds of a model file, and tables to search and to spell them."""

    def __init__(self, path: str) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, dummy_prefix, squeeze, escape, charsmap = UNIGRAM, 1, 1, 1, b""
        with open(path, "rb") as file:
            for number, value in _fields(file.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
                elif number == 2:
                    self.kind = dict(_fields(value)).get(3, UNIGRAM)
                elif number == 3:
                    rule = dict(_fields(value))
                    dummy_prefix, squeeze, escape = rule.get(3, 1), rule.get(4, 1), rule.get(5, 1)
                    charsmap = rule.get(2, b"")
        if not dummy_prefix or squeeze or not escape or charsmap:
            raise ValueError("only models that keep the text as it is, with a space before it, are supported")
        if self.kind not in (UNIGRAM, MERGES) or len(self.pieces) >= NO_PIECE:
            raise ValueError("only unigram and merge models of less than 65,535 pieces are supported")
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind == NORMAL and p]
        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("user-defined pieces are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in usable):
            raise ValueError("a piece crosses the beginning of a word")
        self.cut_lines = not any("\n" in p and len(p) > 1 for p, _, _ in usable)
        self.longest = max(len(p) for p, _, _ in usable)
        self.bytes = np.full(256, -1, np.int64)
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes[int(p[3:-1], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("only models with a piece for every byte are supported")
        self.unknown_score = min(s for _, s, _ in usable) - UNKNOWN_PENALTY
        keys = np.array([self._key(p) for p, _, _ in usable], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.scores = np.array([s for _, s, _ in usable], np.float64)[order]
        self.ids = np.array([i for _, _, i in usable], np.int64)[order]
        self.heads = np.zeros(1 << HEAD_BITS, bool)  # the keys' first bits: most probes end here
        self.heads[self.keys >> np.uint64(64 - HEAD_BITS)] = True
        spelt = [bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind != NORMAL else p.replace(MARK, " ").encode()
                 for p, _, kind in self.pieces]
        self.spelt_counts = np.array([len(x) for x in spelt], np.int64)
        self.spelt_starts = np.cumsum(self.spelt_counts) - self.spelt_counts
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        if self.kind == MERGES:
            self._undo_merges({p: i for p, _, i in usable})

    def _undo_merges(self, ids: dict[str, int]) -> None:
        """Tables for ``_may_follow``: a piece's place in the order of merges (0: a character), the two parts of its last merge,
        which pairs merge into what, and which pieces merging ever makes."""
        ranked = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: -self.pieces[i][1])
        self.place = np.zeros(NO_PIECE + 1, np.int64)
        self.place[ranked] = np.arange(1, len(ranked) + 1)
        self.left, self.right = np.arange(NO_PIECE + 1), np.arange(NO_PIECE + 1)
        self.made = np.zeros(NO_PIECE + 1, bool)
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * (NO_PIECE + 1) + b] = i
            parts, last = list(piece), None
            while len(parts) > 1:
                joined = [self.place[ids[x]] if (x := a + b) in ids else len(ids) + 1 for a, b in zip(parts, parts[1:])]
                at = min(range(len(joined)), key=joined.__getitem__)
                if joined[at] > len(ids):
                    break
                last = parts[at:at + 2]
                parts[at:at + 2] = ["".join(last)]
            self.made[i] = len(parts) == 1
            if last and self.made[i]:
                self.left[i], self.right[i] = ids.get(last[0], NO_PIECE), ids.get(last[1], NO_PIECE)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_places = keys, self.place[[pairs[k] for k in keys.tolist()]]

    def _may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves a border between the two pieces."""
        unique, inverse = np.unique(first * (NO_PIECE + 1) + second, return_inverse=True)
        ok, live = np.ones(len(unique), bool), np.arange(len(unique))
        a, b = unique // (NO_PIECE + 1), unique % (NO_PIECE + 1)
        limit = np.full(len(unique), len(self.pieces) + 2)
        while len(live):
            keys = a * (NO_PIECE + 1) + b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == keys) & (self.pair_places[at] < limit)
            ok[live[crossed]] = False
            place_a, place_b = self.place[a], self.place[b]
            going = ~crossed & ((place_a > 0) | (place_b > 0))
            undo_first = place_a > place_b
            limit = np.where(undo_first, place_a, place_b + 1)[going]
            a, b = np.where(undo_first, self.right[a], a)[going], np.where(undo_first, b, self.left[b])[going]
            live = live[going]
        return ok[inverse]

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        """Hashes of the prefixes of every row, the empty one first."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                out[:, j + 1] = out[:, j] * _BASE + (codes[:, j].astype(np.uint64) + np.uint64(1)) * _SPREAD
        return out

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]), dtype=np.uint64)

    def _key(self, piece: str) -> int:
        return int(self._prefixes(np.array([[ord(c) for c in piece]], np.uint32))[0, -1])

    def _search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of equally long words: ids (-1: a character that is no piece) from the last to the first, and how many."""
        rows, length = codes.shape
        prefixes, powers = self._prefixes(codes), self._powers(self.longest)
        best, every = np.zeros((rows, length + 1)), np.arange(rows)
        back, piece = np.zeros((rows, length + 1), np.int64), np.full((rows, length + 1), NO_PIECE, np.int64)
        for end in range(1, length + 1):
            sizes = np.arange(min(self.longest, end), 0, -1)
            with np.errstate(over="ignore"):
                keys = prefixes[:, end, None] - prefixes[:, end - sizes] * powers[sizes]
            rows_near, near = np.nonzero(self.heads[keys >> np.uint64(64 - HEAD_BITS)])
            probes = keys[rows_near, near]
            at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            hit = self.keys[at] == probes
            at, rows_near, near = at[hit], rows_near[hit], near[hit]
            ids, score = np.full(keys.shape, NO_PIECE), np.full(keys.shape, -np.inf)
            ids[rows_near, near] = self.ids[at]
            if self.kind == UNIGRAM:
                score[:, -1] = best[:, end - 1] + self.unknown_score
                score[rows_near, near] = best[rows_near, end - sizes[near]] + self.scores[at]
            else:
                score[rows_near, near] = np.where(self.made[self.ids[at]], 0.0, -np.inf)
                score[:, -1] = 0.0
                row, column = np.nonzero((score == 0) & (sizes < end))
                border = self._may_follow(piece[row, end - sizes[column]], ids[row, column])
                score[row[~border], column[~border]] = -np.inf
            pick = score.argmax(axis=1)
            best[:, end], back[:, end], piece[:, end] = score[every, pick], sizes[pick], ids[every, pick]
        piece[piece == NO_PIECE] = -1
        found, counts = np.full((rows, length), -1, np.int64), np.zeros(rows, np.int64)
        at, row = np.full(rows, length), np.arange(rows)
        for step in range(length):
            live = at > 0
            if not live.any():
                break
            found[live, step] = piece[row[live], at[live]]
            counts[live] += 1
            at[live] -= back[row[live], at[live]]
        return found, counts

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of every word, where they begin, and the ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts, starts, flat, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        for length in np.unique(lengths).tolist():
            group = np.flatnonzero(lengths == length)
            if not length:
                continue
            step = max(1, CELLS // length)
            for k in range(0, len(group), step):
                some = group[k:k + step]
                text = "".join([words[i] for i in some.tolist()]).replace(" ", MARK)
                codes = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(some), length)
                found, n = self._search(codes)
                column = np.arange(length)
                ids = found[:, ::-1][column >= length - n[:, None]]
                if (ids < 0).any():
                    ids, n = self._spelt_out(codes, ids, n)
                counts[some], starts[some] = n, size + np.cumsum(n) - n
                flat.append(ids.astype(np.uint32))
                size += len(ids)
        return counts, starts, np.concatenate([np.zeros(0, np.uint32), *flat])

    def _spelt_out(self, codes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with the bytes of characters in place of -1."""
        out, counts, at = [], [], 0
        for row, k in zip(codes, n.tolist()):
            spelt, position = [], 0
            for i in ids[at:at + k].tolist():
                if i >= 0:
                    spelt.append(i)
                    position += len(self.pieces[i][0])
                else:
                    spelt.extend(self.bytes[list(chr(row[position]).encode("utf-8", "replace"))].tolist())
                    position += 1
            out.extend(spelt)
            counts.append(len(spelt))
            at += k
        return np.array(out, np.int64), np.array(counts, np.int64)

    def words(self, texts: pa.Array) -> pa.ListArray:
        """Words with the spaces before them (one is put before the text), and line feeds where no longer piece has one."""
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise("", texts, " "))
        marked = pc.replace_substring_regex(spaced, "([^ ]) ", "\\1\x00 ")
        if self.cut_lines:
            marked = pc.replace_substring(marked, "\n", "\x00\n\x00")
        return pc.split_pattern(marked, "\x00")

    def encode(self, texts: pa.Array, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of them in each; ``table`` encodes with ``encode_words``."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        odd = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
        if not odd.any():
            lists = self.words(texts)
            slots = table.look_up(lists.flatten())
            return table.gather(slots), by_text(lists, table.counts[slots])
        ids, counts = [], []
        for text in texts.to_pylist():  # the cut mark is in a text: that one is searched as one word
            if "\x00" in text:
                n, _, found = self.encode_words([" " + text])
                ids.append(found)
                counts.append(int(n[0]))
            else:
                found, n = self.encode(pa.array([text]), table)
                ids.append(found)
                counts.append(int(n[0]))
        return np.concatenate(ids), np.array(counts, np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts that ``counts`` of the ids each stand for."""
        ids = ids.astype(np.int64)
        known = np.where((ids >= 0) & (ids < len(self.pieces)), ids, 0)
        sizes = np.where(known == ids, self.spelt_counts[known], 0)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.spelt[np.repeat(self.spelt_starts[known] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        return [x[1:] if x[:1] == " " else x for x in out]


def _with(docs: DataFrame, *columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*docs.schema.fields, *[T.StructField(*c) for c in columns]])


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with a column ``into``: the ids of the text under the model file ``model``."""
    into, pieces = fresh(docs, into), PieceModel(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(pieces.encode_words)
        for batch in slices(batches, text, TEXT_BYTES):
            ids, counts = pieces.encode(batch.column(text), table)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, _with(docs, (into, T.ArrayType(T.IntegerType()))))


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with a column ``into``: the text of the ids in column ``ids``."""
    into, pieces = fresh(rows, into), PieceModel(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(ids)
                flat = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pieces.decode(flat, counts), pa.string())],
                                                 names=[*part.schema.names, into])

    return rows.mapInArrow(run, _with(rows, (into, T.StringType())))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, their checksum, and whether they decode to the same text."""
    import public_tokenizers

    pieces = PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(pieces.encode_words)
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, counts = pieces.encode(batch.column("text"), table)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            same = [a == (b or "") for a, b in zip(pieces.decode(ids, counts), batch.column("text").to_pylist())]
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
            lists = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()),
                                              pa.array(same, pa.bool_()), lists],
                                             names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, ids array<int>")


QUERIES = {"op3_pieces": op3_pieces}
ORACLES: dict[str, str] = {}
