"""Quality classifier: a byte-level convolutional network in numpy, trained here on a bounded sample of labelled documents.

Filters slide over the UTF-8 bytes of a text; the strongest answer of each filter in a chunk is kept (max-pooling), chunks overlap
and cover the whole document, and the mean and the maximum over the chunks give one probability. A filter over one-hot bytes is a
table of weights by byte and position, so a convolution is a sum of table look-ups. Max-pooling is done in blocks, of which
overlapping chunks share their parts.

Defined results: a null or empty text gets a score like any other; documents without a label take no part in training; several
labels of one id count as the lowest; without labels of both kinds every score is the share of label 1 (0.5 without any); repeated
rows score equally; other columns are kept, and the verdict's column takes underscores if its name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.arrow import slices
from abacist.llm.columns import fresh

WIDTH, FILTERS = 4, 8
BLOCK = 64
#: A chunk is four blocks and begins three blocks after the one before, so neighbours share 64 bytes.
CHUNK, STEP = 4, 3
#: Never occurs in UTF-8: fills a document's last block.
PAD = 0xFF
#: Bytes that a task convolves at once.
STRIP = 1 << 17

#: Bounds of the training sample: documents by label (those first by a hash of their id) and bytes of each, in blocks spread
#: evenly over the whole text.
SAMPLE_DOCS, SAMPLE_BLOCKS = 1500, 32
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.02, 1e-4
#: Every fifth document by checksum of its id never trains.
FOLDS = 5
CUT = 0.3


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of whole blocks, and the number of blocks of each."""
    blocks = np.array([-(-(len(x) + WIDTH - 1) // BLOCK) for x in texts], np.int64)
    flat = np.full(int(blocks.sum()) * BLOCK + WIDTH, PAD, np.uint8)
    at = 0
    for text, n in zip(texts, blocks.tolist()):
        flat[at:at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * BLOCK
    return flat, blocks


def convolve(filters: np.ndarray, flat: np.ndarray, ends: np.ndarray, first: int, last: int) -> np.ndarray:
    """Answers of the filters at the positions of blocks ``first`` to ``last``: (blocks, positions, filters).

    ``ends`` are the last blocks of the documents (of all, in order): what begins in the filling there and reaches into the next
    document is no answer.
    """
    a, b = first * BLOCK, last * BLOCK
    out = filters[0].take(flat[a:b], axis=0)
    for j in range(1, WIDTH):
        out += filters[j].take(flat[a + j:b + j], axis=0)
    out = out.reshape(last - first, BLOCK, FILTERS)
    out[ends[np.searchsorted(ends, first):np.searchsorted(ends, last)] - first, 1 - WIDTH:] = -np.inf
    return out


def block_maxima(filters: np.ndarray, flat: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    step, ends, n = STRIP // BLOCK, np.cumsum(blocks) - 1, int(blocks.sum())
    parts = [convolve(filters, flat, ends, i, min(n, i + step)).max(axis=1) for i in range(0, n, step)]
    return np.concatenate(parts) if parts else np.zeros((0, FILTERS), np.float32)


def chunk_bounds(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last (exclusive) block of every chunk, and the first chunk of every document."""
    chunks = np.maximum(1, -(-(blocks - CHUNK) // STEP) + 1)
    ends = np.cumsum(blocks)
    heads = np.cumsum(chunks) - chunks
    doc = np.repeat(np.arange(len(blocks)), chunks)
    first = (ends - blocks)[doc] + STEP * (np.arange(int(chunks.sum())) - heads[doc])
    return first, np.minimum(first + CHUNK, ends[doc]), heads


def over_chunks(maxima: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Maximum over the blocks of each chunk."""
    out = maxima[first]
    for k in range(1, CHUNK):
        at = np.minimum(first + k, last - 1)
        np.maximum(out, maxima[at], out=out)
    return out


def features(answers: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Mean and maximum over the chunks of each document."""
    counts = np.diff(np.append(heads, len(answers)))[:, None]
    return np.concatenate([np.add.reduceat(answers, heads, axis=0) / counts, np.maximum.reduceat(answers, heads, axis=0)], axis=1)


class Model:
    def __init__(self, filters: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float) -> None:
        self.filters, self.bias, self.weights, self.offset = filters, bias, weights, offset

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        flat, blocks = layout(texts)
        first, last, heads = chunk_bounds(blocks)
        pooled = over_chunks(block_maxima(self.filters, flat, blocks), first, last)
        logits = features(np.tanh(pooled + self.bias), heads) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, share: float) -> Model:
    """Gradient descent (Adam) over balanced batches; ``share`` of label 1 among all labelled documents shifts the result from
    the sample's balance to theirs."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(7)
    filters = (rng.normal(size=(WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
    bias, weights = np.zeros(FILTERS, np.float32), (rng.normal(size=2 * FILTERS) * 0.3).astype(np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(filters, bias, np.zeros_like(weights), prior)
    params = [filters, bias, weights, np.zeros(1, np.float32)]
    moments, scales, steps = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    importance = np.where(labels == 1, 0.5 / np.mean(labels == 1), 0.5 / np.mean(labels == 0))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            picked = order[at:at + BATCH]
            flat, blocks = layout([texts[i] for i in picked])
            first, last, heads = chunk_bounds(blocks)
            answers = convolve(filters, flat, np.cumsum(blocks) - 1, 0, int(blocks.sum()))
            where = answers.argmax(axis=1)
            maxima = np.take_along_axis(answers, where[:, None, :], axis=1)[:, 0, :]
            pooled = over_chunks(maxima, first, last)
            active = np.tanh(pooled + bias)
            counts = np.diff(np.append(heads, len(active)))
            doc = np.repeat(np.arange(len(picked)), counts)
            given = features(active, heads)
            p = 1 / (1 + np.exp(-np.clip(given @ weights + params[3][0], -30, 30)))
            slope = ((p - labels[picked]) * importance[picked] / len(picked)).astype(np.float32)
            back = slope[doc, None] * weights[:FILTERS] / counts[doc, None]
            back = back + slope[doc, None] * weights[FILTERS:] * (active == given[doc, FILTERS:])
            back *= 1 - active ** 2
            # The gradient of a maximum goes to the block, and in it to the position, that holds it.
            block = np.repeat(first[:, None], FILTERS, axis=1)
            for k in range(1, CHUNK):
                at_k = np.minimum(first + k, last - 1)[:, None]
                block = np.where(maxima[at_k, np.arange(FILTERS)] > maxima[block, np.arange(FILTERS)], at_k, block)
            spot = block * BLOCK + where[block, np.arange(FILTERS)]
            slopes = [np.zeros_like(filters), back.sum(axis=0), given.T @ slope, np.array([slope.sum()], np.float32)]
            column = np.broadcast_to(np.arange(FILTERS), spot.shape)
            for j in range(WIDTH):
                np.add.at(slopes[0][j], (flat[spot + j], column), back)
            steps += 1
            for x, m, v, g in zip(params, moments, scales, slopes):
                g = g + DECAY * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.99 ** steps)) + 1e-8)
    return Model(filters, bias, weights, float(params[3][0]) + prior)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most SAMPLE_DOCS documents of each label (doc_id, quality), none of them held out.

    Runs Spark jobs at once; the driver gets at most 2 * SAMPLE_DOCS * SAMPLE_BLOCKS * BLOCK bytes of text.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    numbers = {row.label: row.n for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = numbers.get(1, 0) / sum(numbers.values()) if numbers else 0.5
    picked = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
        picked = some if picked is None else picked.unionByName(some)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                n = len(data) // BLOCK
                if n > SAMPLE_BLOCKS:
                    starts = np.linspace(0, n - CHUNK, SAMPLE_BLOCKS // CHUNK).astype(int) * BLOCK
                    data = b"".join(data[i:i + CHUNK * BLOCK] for i in starts)
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())],
                                             names=["doc_id", "label", "data"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")) \
        .mapInArrow(cut, "doc_id long, label int, data binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([bytes(r.data) for r in rows], np.array([r.label for r in rows], np.int64), share)


def classify(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: the probability of label 1, from the text alone."""
    into = fresh(docs, into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            scores = model.score([(x or "").encode() for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLES: dict[str, str] = {}
