"""N-gram Jaccard join by universe partitions and the pigeonhole principle; every candidate pair is verified exactly.

Two sets of sizes s and t with a Jaccard similarity of at least p / q differ in at most (s + t) * (q - p) / (q + p) elements.
The universe of shingles is cut, by hash, into so many segments that such a pair must agree on one: sets go by size into bands,
each with its own number of segments, and a set near the upper end of its band is indexed under the next one too. A segment
is either probed exactly (the subset of the set in it is one signature) or with one deletion (the subset and all subsets
without one element are). With levels t(i) of 0 and 1 a pair of difference D must meet if the sum of t(i) + 1 over the
probed segments is above D. The levels are allocated by cost: the fewest signatures with which a set of the band's sizes is
expected to get there. What would meet everybody is not probed at all: empty subsets, and shingles that a large part of all
documents have (they are kept out of the segments). A set gets further segments in exchange; one that has not enough left is
indexed once more with all its shingles, and if that is not enough, with its empty segments too, and meets its like there.

Equal sets are joined first. Sets that share a signature make a group, named by the smallest of them: each of them gives one row, not
one for each other. Most sets that meet are far apart, and the more of them the larger the input is. So parities go first, about a
bit for each element: two sets differ in at least as many elements as their parities in bits. Members whose parities rule
out every other one of the group leave it, and only the sets of the rest move. Groups are resolved in chunks of bounded size (see ``links``): within a chunk, sets meet by their differences
from the chunk's majority, in which whatever most of them share is no element. A group of several chunks is described once more:
each set by its difference from the majority of a sample that all chunks see. What is close enough to it is linked outright, and
sets of the group that share one of the first elements of their differences make smaller groups, which are resolved in the same way, until none
is left. So links cost rows in proportion to sets, and no link between components is lost.

Shingles are 64-bit hashes of words; two different ones of a pair of sets of n elements agree with odds of about n² / 2⁶⁴.

Defined results: a null or empty text, or one of white space, has no shingles and is linked with nothing; with fewer words than a
shingle has, all words are one shingle. Several rows of one doc_id are judged by their own texts each. A row without doc_id
takes the component of equal texts that have one, else null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.arrow import slices
from abacist.llm.columns import fresh
from abacist.llm.components import components
from abacist.llm.tables import Tables

#: Each band of sizes ends at this multiple of its beginning.
BAND = 1.5
#: Shingles that at least one of so many documents has are kept out of the segments.
COMMON_SHARE = 1000
#: Sides of at most so many ids are sent to all executors (8 to 40 bytes each); larger ones are shuffled.
BROADCAST_IDS = 1_000_000
#: What tells sets apart: their size and two hashes.
KEY = ("n", "k1", "k2")

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> _S30)) * _M2
        x = (x ^ (x >> _S27)) * _M3
        return x ^ (x >> _S31)


class WordHashes(dict):
    """64-bit hash by word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode())
        return value


def shingle_sets(texts: pa.Array, width: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of every text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    known = np.fromiter((hashes[w] for w in words), np.uint64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
    empty = words.index("") if "" in words else -1
    real = coded.indices.to_numpy(zero_copy_only=False) != empty
    bounds = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    known = known[real]
    with np.errstate(over="ignore"):
        for a, b in zip(bounds, bounds[1:]):
            some = known[a:b]
            n = max(1, len(some) - width + 1)
            if not len(some):
                yield some
                continue
            value = np.full(n, len(some) if len(some) < width else width, np.uint64)
            for j in range(min(width, len(some))):
                value = mix(value ^ some[j:j + n])
            yield np.unique(value)


class Scheme:
    """Segments of a band of sizes: the first ``m1`` are probed with one deletion, the others exactly."""

    def __init__(self, low: int, high: int, p: int, q: int) -> None:
        self.m1, self.m = 0, 1
        most = difference(high, p, q) + 1
        best = math.inf
        for m1 in range(0, most // 2 + 2, max(1, most // 24)):
            for m0 in range(max(0, most - 2 * m1, 1 - m1), 3 * most + 8):
                m = m0 + m1
                if all(self._expected(m0, m1, s) >= difference(s, p, q) + 1 for s in (low, high)):
                    rows = m + m1 * high / m
                    if rows < best:
                        best, self.m1, self.m = rows, m1, m
                    break

    @staticmethod
    def _expected(m0: int, m1: int, size: int) -> float:
        """What the segments' levels add up to, less a margin, for a set of this size."""
        mean = size / (m0 + m1)
        none, one = math.exp(-mean), mean * math.exp(-mean)
        bad = 2 * m1 * (none + one) + m0 * none
        return 2 * m1 + m0 - (bad + 2 * math.sqrt(bad) if m0 + m1 > 1 else 0)


def difference(size: int, p: int, q: int) -> int:
    """Most elements in which a set of this size differs from any set that is similar enough."""
    return (size + size * q // p) * (q - p) // (q + p)


class Partitions:
    """Signatures of sets under a similarity of at least p / q."""

    def __init__(self, p: int, q: int, common: np.ndarray) -> None:
        self.p, self.q, self.common = p, q, np.sort(common)
        self.starts, self.schemes = [1], {}

    def _band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND)))
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def _scheme(self, band: int) -> Scheme:
        if band not in self.schemes:
            while len(self.starts) < band + 2:
                self._band(self.starts[-1])
            low, high = self.starts[band], self.starts[band + 1] - 1
            self.schemes[band] = Scheme(max(1, -(-low * self.p // self.q)), high, self.p, self.q)
        return self.schemes[band]

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        size = len(elements)
        band = self._band(size)
        bands = [band, band + 1] if size * self.q // self.p >= self.starts[band + 1] else [band]
        rare = elements
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, elements), len(self.common) - 1)
            rare = elements[self.common[at] != elements]
        out = []
        for k in bands:
            scheme, need = self._scheme(k), difference(size, self.p, self.q) + 1
            found, enough = self._of(rare, scheme.m, scheme.m1, need, np.uint64(k << 24))
            out.append(found)
            if not enough and len(rare) < size:
                found, enough = self._of(elements, scheme.m, scheme.m1, need, np.uint64((1 << 40) + (k << 24)))
                out.append(found)
            if not enough:
                m = difference(self.starts[k + 1] - 1, self.p, self.q) + 1
                out.append(self._of(elements, m, 0, need, np.uint64((2 << 40) + (k << 24)), True)[0])
        return np.unique(np.concatenate(out))

    @staticmethod
    def _of(elements: np.ndarray, m: int, m1: int, need: int, tag: np.uint64, empties: bool = False) -> tuple[np.ndarray, bool]:
        """Signatures of the first segments that are ``need`` together, and whether there are so many."""
        segment = ((elements >> _S32) * np.uint64(m)) >> _S32
        starts = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
        sizes = np.diff(starts)
        spread = mix(elements)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
            own = sums[starts[1:]] - sums[starts[:-1]]
            gain = np.where(sizes > 0, 1, 0) if not empties else np.ones(m, np.int64)
            gain[:m1] = np.where(sizes[:m1] > 1, 2, 0)
            total = np.cumsum(gain)
            last = int(np.searchsorted(total, need))
            enough, last = last < m, min(last + 1, m)
            used = np.arange(last)
            if not empties:
                used = used[sizes[:last] > 0]
            values, names = [own[used]], [used]
            for i in range(min(m1, last)):
                if sizes[i] > 1:
                    values.append(own[i] - spread[starts[i]:starts[i + 1]])
                    names.append(np.full(sizes[i], i))
            return mix(np.concatenate(values) ^ mix(np.concatenate(names).astype(np.uint64) + tag)), enough


def parity(elements: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls on each of so many bits as there are elements, or up to twice as many (64 at least)."""
    m = 64
    while m < len(elements):
        m *= 2
    odd = np.bincount((elements & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def plausible(sizes: np.ndarray, parities: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """Which sets have another one that their parities do not rule out; ``sizes`` ascend. No linked set is refused."""
    out, lengths = np.zeros(len(sizes), bool), np.array([len(x) for x in parities])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        ends = np.searchsorted(sizes, sizes[own] * q // p, side="right")
        first, last = int(own[0]), int(ends[-1])
        # Larger sets' parities fold to the length of the smaller one's.
        folded = np.array([np.bitwise_xor.reduce(x.reshape(-1, length), axis=0) for x in parities[first:last]])
        for i, end in zip(own.tolist(), ends.tolist()):
            apart = np.bitwise_count(folded[i + 1 - first:end - first] ^ folded[i - first]).sum(axis=1, dtype=np.int64)
            near = (q + p) * apart <= (q - p) * (sizes[i] + sizes[i + 1:end])
            out[i] |= near.any()
            out[i + 1:end] |= near
    return out


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles of at least one in COMMON_SHARE documents, counted over all of them.

    Only such as are frequent in some part of the input can be; so few exist (documents have a bounded mean length) that they fit
    the driver. They decide what is cheap to index, not what is found.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept, numbers, seen = WordHashes(), np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in slices(batches):
            sets = [x for x in shingle_sets(batch.column("text"), width, hashes)]
            seen += len(sets)
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            frequent = n >= max(2, len(sets) // (2 * COMMON_SHARE))
            kept, inverse = np.unique(np.concatenate([kept, found[frequent]]), return_inverse=True)
            numbers = np.bincount(inverse, np.concatenate([numbers, n[frequent]]), len(kept)).astype(np.int64)
            still = numbers >= max(2, seen // (4 * COMMON_SHARE))
            kept, numbers = kept[still], numbers[still]
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(kept.view(np.int64)), "n": pa.array(numbers)})

    n = docs.count()
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "shingle long, n long") \
        .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= max(20, n // COMMON_SHARE)).select("shingle").toArrow()
    return rows.column(0).to_numpy().view(np.uint64)


def _set_key(x: np.ndarray) -> list[int]:
    """Two hashes of a whole set."""
    with np.errstate(over="ignore"):
        return np.array([mix(x).sum(dtype=np.uint64), mix(x ^ _M3).sum(dtype=np.uint64)]).view(np.int64).tolist()


#: Elements of a chunk: what one task resolves at once (8 bytes each).
CHUNK_ELEMENTS = 1 << 19
#: Pairs of a chunk that are looked at together.
PAIRS = 1 << 18
#: Members of a group of several chunks that all of them see, about so many.
SAMPLE_SETS = 32
#: Members of the largest groups whose parities are compared; larger ones stay as they are.
PARITY_SETS = 2048


class Links:
    """Joins members and remembers which unions did it."""

    def __init__(self, n: int) -> None:
        self.top, self.made = list(range(n)), []

    def find(self, i: int) -> int:
        while self.top[i] != i:
            self.top[i] = self.top[self.top[i]]
            i = self.top[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.top[max(a, b)] = min(a, b)
            self.made.append((i, j))


def _slack(apart: np.ndarray, sizes: np.ndarray, p: int, q: int) -> np.ndarray:
    """(q + p) * apart - (q - p) * size. Sets at distances e and f from any one set are linked if their slacks add up to 0 or less,
    and only if their differences from it share at least the sum over 2 * (q + p)."""
    return (q + p) * apart - (q - p) * sizes


def _prefixes(apart: np.ndarray, sizes: np.ndarray, slack: np.ndarray, lowest, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first elements of a difference will do to meet any partner of higher slack, and of lower (not below ``lowest``).

    Of two sets that are linked, but not outright, the one of lower slack s shares s / (q + p) elements at least, or one. The other
    shares the mean of both slacks; and as no more is shared than the partner's difference holds, that is its own slack
    less (q - p) times the partner's size at least, which is at most its own times q / p.
    """
    few = np.maximum(1, -(-slack // (q + p)))
    most = np.maximum(1, np.maximum(-(-(slack + lowest) // (2 * (q + p))), -(-(slack - (q - p) * (sizes * q // p)) // (q + p))))
    return np.maximum(0, apart - few + 1), np.maximum(0, apart - most + 1)


def links(sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Pairs of linked sets that connect whatever links connect: exact, with prefix filters on differences from the majority."""
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    names, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    major = np.flatnonzero(2 * counts > m)
    held = np.where(2 * counts > m, m - counts, counts)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(names))
    shared = np.sort(held)  # by rank: in how many differences an element is
    apart = [np.sort(rank[np.setxor1d(at[bounds[i]:bounds[i + 1]], major, assume_unique=True)]) for i in range(m)]
    far = np.array([len(x) for x in apart], np.int64)
    slack = _slack(far, sizes, p, q)
    out, first = Links(m), int(slack.argmin())
    for i in np.flatnonzero(slack + slack[first] <= 0).tolist():
        if i != first:
            out.join(first, i)
    short, long = _prefixes(far, sizes, slack, int(slack[first]), p, q)
    place = np.empty(m, np.int64)
    place[np.argsort(slack, kind="stable")] = np.arange(m)

    def rows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        element = np.concatenate([x[:k] for x, k in zip(apart, lengths)])
        owner = np.repeat(np.arange(m), lengths)
        left = np.repeat(far, lengths) - (np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        met = shared[element] > 1
        return element[met], owner[met], left[met]

    element, owner, left = rows(np.minimum(short, far))
    order = np.argsort(element, kind="stable")
    element, owner, left = element[order], owner[order], left[order]
    asked, asker, remain = rows(np.minimum(long, far))
    low, high = np.searchsorted(element, asked), np.searchsorted(element, asked, side="right")
    total, refused, seen = np.cumsum(high - low), [], np.zeros(0, np.int64)
    for a in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        some = np.arange(a, min(a + PAIRS, int(total[-1])))
        row = np.searchsorted(total, some, side="right")
        other = low[row] + some - (total[row] - (high - low)[row])
        b, c = asker[row], owner[other]
        both, top = slack[b] + slack[c], np.array([out.find(i) for i in range(m)])
        ok = (top[b] != top[c]) & (place[c] < place[b]) & (both > 0) & (2 * (q + p) * np.minimum(remain[row], left[other]) >= both) \
            & ((q + p) * np.abs(far[b] - far[c]) <= (q - p) * (sizes[b] + sizes[c]))
        for pair in np.setdiff1d(b[ok] * m + c[ok], seen).tolist():
            b, c = divmod(pair, m)
            if out.find(b) != out.find(c):
                common = len(np.intersect1d(apart[b], apart[c], assume_unique=True))
                if (q + p) * (far[b] + far[c] - 2 * common) <= (q - p) * (sizes[b] + sizes[c]):
                    out.join(b, c)
                else:
                    refused.append(pair)
        seen = np.array(refused, np.int64)
    return out.made


def _plausible(members: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """``members`` (g, node) without those whose parities rule out every other member of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> pa.RecordBatch:
            some = [x for x, ok in zip(found, plausible(np.array(sizes, np.int64), parities, p, q)) if ok]
            return pa.RecordBatch.from_pydict({"g": pa.array([group] * len(some), pa.int64()), "node": pa.array(some, pa.int64())})

        group, found, sizes, parities = None, [], [], []
        for batch in batches:
            for g, node, n, bits in zip(*(batch.column(c).to_pylist() for c in ("g", "node", "n", "parity"))):
                if g != group:
                    if len(found) > 1:
                        yield kept()
                    group, found, sizes, parities = g, [], [], []
                if not found or found[-1] != node:  # several rows of one doc_id may have the set
                    found.append(node)
                    sizes.append(n)
                    parities.append(np.frombuffer(bits, np.uint64))
        if len(found) > 1:
            yield kept()

    counted = members.join(members.groupBy("g").agg(F.count("*").alias("sets")), "g")
    few = counted.where(F.col("sets") <= PARITY_SETS).select("g", "node").join(nodes.select("node", "n", "parity"), "node")
    out = few.repartition("g").sortWithinPartitions("g", "n", "node").mapInArrow(run, "g long, node long")
    return out.unionByName(counted.where(F.col("sets") > PARITY_SETS).select("g", "node"))


_RESOLVED = "g long, a long, b long, slack long, short int, prefix array<long>"
_FIELDS = ("g", "a", "b", "slack", "short", "prefix")


def _resolve(p: int, q: int):
    """Rows come by chunk. Links within each; and of chunks that are not a whole group every set's difference from the sample's
    majority: its slack, and its first elements, those that the sample has in few differences before others."""

    def one(g: int, nodes: list, roles: list, sets: list) -> pa.RecordBatch:
        made = links(sets, p, q)
        pairs = [(g, nodes[i], nodes[j], None, None, None) for i, j in made]
        sample = [x for x, r in zip(sets, roles) if r < 2]
        if any(roles):
            names, counts = np.unique(np.concatenate(sample), return_counts=True) if sample else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            major = names[2 * counts > len(sample)]
            held = np.where(2 * counts > len(sample), len(sample) - counts, counts)
            for node, role, x in zip(nodes, roles, sets):
                if role:
                    apart = np.setxor1d(x, major, assume_unique=True)
                    seen = np.zeros(len(apart), np.int64)
                    if len(names):
                        at = np.minimum(np.searchsorted(names, apart), len(names) - 1)
                        seen = np.where(names[at] == apart, held[at], 0)
                    apart = apart[np.lexsort((apart, seen))]
                    slack = _slack(np.array([len(apart)]), np.array([len(x)]), p, q)
                    short, long = _prefixes(np.array([len(apart)]), np.array([len(x)]), slack, -10**12, p, q)
                    pairs.append((g, node, None, int(slack[0]), int(short[0]), apart[:max(short[0], long[0])].view(np.int64)))
        columns = list(zip(*pairs)) or [[]] * len(_FIELDS)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=list(_FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, nodes, roles, sets = None, [], [], []
        for batch in batches:
            elements = batch.column("elements")
            for i, (g, number, node, role) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "chunk", "node", "role")))):
                if chunk != (g, number):
                    if len(nodes) > 1 or any(roles):
                        yield one(chunk[0], nodes, roles, sets)
                    chunk, nodes, roles, sets = (g, number), [], [], []
                if not nodes or nodes[-1] != node:  # several rows of one doc_id may have the set
                    nodes.append(node)
                    roles.append(role)
                    sets.append(elements[i].values.to_numpy().view(np.uint64).copy())
        if len(nodes) > 1 or any(roles):
            yield one(chunk[0], nodes, roles, sets)
    return run


def _resolved(members: DataFrame, docs: DataFrame, classes: DataFrame, width: int, p: int, q: int, tables: Tables, name: str) -> DataFrame:
    """Links (a, b) within groups, and descriptions of the sets of groups that have several chunks. ``members`` has g and node once each."""
    sized = members.join(classes, "node")
    groups = sized.groupBy("g").agg(F.ceil(F.sum("n") / CHUNK_ELEMENTS).cast("int").alias("parts"), F.count("*").alias("sets"))
    own, several = F.pmod(F.xxhash64("node"), "parts").cast("int"), F.col("parts") > 1
    sampled = several & (F.pmod(F.xxhash64("node", "g"), F.greatest(F.lit(1), F.floor(F.col("sets") / SAMPLE_SETS))) == 0)
    dealt = sized.join(groups, "g").withColumn("own", own).withColumn("sampled", sampled)
    dealt = dealt.withColumn("chunk", F.explode(F.when(F.col("sampled"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
    # 0: in the chunk for comparison only, or the group has one chunk; 1: in the sample too; 2: not in it.
    role = F.when(~several | (F.col("chunk") != F.col("own")), 0).when(F.col("sampled"), 1).otherwise(2)
    wanted = tables.save(dealt.groupBy("node", "doc", *KEY).agg(F.collect_list(F.struct("g", "chunk", role.alias("role"))).alias("to")), f"{name}-wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, limit=1 << 20):
            keys = zip(*(batch.column(c).to_pylist() for c in KEY))
            for x, key, node, to in zip(shingle_sets(batch.column("text"), width, hashes), keys, batch.column("node").to_pylist(), batch.column("to").to_pylist()):
                if [len(x), *_set_key(x)] != list(key):  # another text of the same doc_id
                    continue
                held, step = pa.array(x.view(np.int64)), max(1, (1 << 20) // len(x))
                for k in range(0, len(to), step):
                    some = to[k:k + step]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(x)), pa.concat_arrays([held] * len(some)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d["g"] for d in some], pa.int64()), pa.array([d["chunk"] for d in some], pa.int32()), pa.array([node] * len(some), pa.int64()),
                         pa.array([d["role"] for d in some], pa.int32()), lists], names=["g", "chunk", "node", "role", "elements"])

    whole = docs.join(wanted, docs.doc_id == wanted.doc).select("node", *KEY, "to", "text")
    sets = whole.mapInArrow(deal, "g long, chunk int, node long, role int, elements array<long>")
    out = tables.save(sets.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "node").mapInArrow(_resolve(p, q), _RESOLVED), name)
    tables.drop(f"{name}-wanted")
    return out


def _smaller_groups(far: DataFrame, linked: DataFrame) -> DataFrame:
    """g, node: sets of groups that links do not connect yet, by an element that their differences' beginnings share.

    Of the lists of one group that hold the same sets one will do.
    """
    rows = far.join(linked.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    live = rows.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g")
    rows = rows.join(live, "g", "left_semi").select("g", "a", "component", "short", F.posexplode("prefix").alias("at", "element"))
    rows = rows.select(F.xxhash64("g", "element").alias("key"), "a", "component", (F.col("at") < F.col("short")).alias("first")).repartition("key")
    lists = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("first").alias("first"),
                                    F.bit_xor(F.xxhash64("a")).alias("h"), F.min("a").alias("m")).where("low <> high and first")
    kept = lists.groupBy("c", "h", "m").agg(F.min("key").alias("key")).select("key")
    return rows.join(kept, "key").select(F.col("key").alias("g"), F.col("a").alias("node")).distinct()


def jaccard_join(docs: DataFrame, width: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text): documents link where the Jaccard similarity of
    their sets of ``width``-word shingles is at least p / q; component_id is the smallest doc_id that links reach.

    Runs Spark jobs at once and writes tables below the shared folder.
    """
    return _judged(docs, width, p, q).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _judged(docs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """doc_id, n, k1, k2, component_id of every row of ``docs``. Each different set is a node of its own, whatever doc_ids have it."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tables = Tables(spark, "jaccard-join")
    index = Partitions(p, q, common_shingles(docs, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, limit=2 << 20):
            found = list(shingle_sets(batch.column("text"), width, hashes))
            keys = [_set_key(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([index.signatures(x).view(np.int64) if len(x) else [] for x in found], pa.list_(pa.int64())),
                 pa.array([parity(x).tobytes() for x in found], pa.binary())],
                names=["doc_id", "n", "k1", "k2", "signatures", "parity"])

    key = list(KEY)
    signed = tables.save(docs.mapInArrow(sign, "doc_id long, n long, k1 long, k2 long, signatures array<long>, parity binary"), "signed")
    classes = tables.save(signed.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("doc"))
                          .withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = tables.save(signed.withColumn("doc", F.col("doc_id")).join(classes, [*key, "doc"]).select("node", "n", "signatures", "parity"), "nodes")
    rows_of = tables.save(signed.drop("signatures", "parity"), "rows")
    tables.drop("signed")

    # Dealt out by signature once: the smallest set of each, and the rows that meet it, are read from the same shuffle.
    rows = nodes.select("node", F.explode("signatures").alias("signature")).repartition("signature")
    shared = rows.groupBy("signature").agg(F.min("node").alias("g"), F.count("*").alias("c")).where("c > 1").select("signature", "g")
    met = tables.save(rows.join(shared, "signature").select("g", "node").distinct(), "met")
    members = tables.save(_plausible(met, nodes, p, q), "members-0")
    tables.drop("nodes", "met")
    edges, step = None, 0
    while True:
        found = _resolved(members, docs, classes, width, p, q, tables, f"found-{step}")
        tables.drop(f"members-{step}")
        more, far = found.where("b is not null").select("a", "b"), found.where("b is null").drop("b")
        edges = more if edges is None else edges.unionByName(more)
        if far.isEmpty():
            break
        nearest = far.groupBy("g").agg(F.min(F.struct("slack", "a")).alias("nearest"))
        outright = far.join(nearest, "g").where("slack + nearest.slack <= 0 and a <> nearest.a").select("a", F.col("nearest.a").alias("b"))
        edges = edges.unionByName(tables.save(outright, f"outright-{step}"))
        linked = tables.save(components(edges, tables, f"linked-{step}"), f"linked-{step}")
        step += 1
        members = tables.save(_smaller_groups(far, linked), f"members-{step}")
        if members.isEmpty():
            break
    linked = tables.save(components(edges, tables, "all"), "all")
    tables.drop(*[f"{kind}-{k}" for k in range(step + 1) for kind in ("members", "found", "outright", "linked")])

    lowest = tables.save(linked.join(classes, "node").groupBy("component").agg(F.min("doc").alias("lowest")), "lowest")
    if lowest.count() <= BROADCAST_IDS:
        lowest = F.broadcast(lowest)
    named = linked.join(lowest, "component").select("node", "lowest")
    classes = classes.join(named, "node", "left").select(*key, F.coalesce("lowest", "doc").alias("component"))
    return rows_of.join(classes, key, "left").select(
        "doc_id", *key, F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_keys(docs: DataFrame, width: int, into: str) -> DataFrame:
    """``docs`` with the key of each row's set."""
    key = T.StructType([T.StructField(c, T.LongType()) for c in KEY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, limit=1 << 20):
            keys = [dict(zip(KEY, (len(x), *_set_key(x)))) for x in shingle_sets(batch.column("text").cast(pa.string()), width, hashes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.struct([(c, pa.int64()) for c in KEY]))],
                                             names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, key)]))


def one_of_each(docs: DataFrame, width: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """Rows of ``docs`` without those that are similar to one of a smaller doc_id, directly or by way of others.

    Of several rows of one doc_id one stays that is no copy itself; of rows without a doc_id those whose text no other row has, and one of equal ones.
    """
    found = _judged(docs, width, p, q).where("doc_id is not null")
    copy = F.col("component_id") < F.col("doc_id")
    marks = found.groupBy("doc_id").agg(F.min(copy).alias("copy"), F.count("*").alias("rows"), F.min(F.when(~copy, F.struct(*KEY))).alias("own"))
    id_name, copy_name, own_name, set_name = (fresh(docs, c) for c in ("copy_id", "copy_of", "copy_own", "copy_set"))
    marks = Tables(docs.sparkSession, "one-of-each").save(
        marks.where("copy or rows > 1").select(F.col("doc_id").alias(id_name), F.col("copy").alias(copy_name), F.col("own").alias(own_name)), "marks")

    def kept(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        listed = F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed
        return rows.join(listed, rows["doc_id"].cast("long") == listed[id_name], how)

    out = kept(docs, marks, "left_anti")
    repeated = marks.where(~F.col(copy_name))
    if not repeated.isEmpty():
        rows = kept(_with_keys(docs.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated,
                                         docs["doc_id"].cast("long") == repeated[id_name], "left_semi"), width, set_name), repeated, "inner")
        rows = rows.where(F.col(set_name) == F.col(own_name))
        out = out.unionByName(rows.select(*docs.columns).dropDuplicates(["doc_id"]))
    if docs.where("doc_id is null").isEmpty():
        return out
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    nameless = keyed.where("doc_id is null").dropDuplicates([key])
    nameless = nameless.join(keyed.where("doc_id is not null").select(key).distinct(), key, "left_anti")
    return out.where("doc_id is not null").unionByName(nameless.select(*docs.columns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, p=90, q=100)


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES: dict[str, str] = {"op9_jaccard_join": r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS shingle
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
links AS (
  SELECT p.a, p.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS i FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.r <> y.r
                        GROUP BY x.r, y.r) p JOIN sizes s ON s.r = p.a JOIN sizes t ON t.r = p.b
  WHERE 100 * i >= 90 * (s.n + t.n - i)),
reach AS (
  SELECT r AS a, r AS b FROM texts UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
firsts AS (SELECT reach.a AS r, min(t.doc_id) AS component_id FROM reach JOIN texts t ON t.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM texts LEFT JOIN sizes USING (r) LEFT JOIN firsts USING (r)
"""}
