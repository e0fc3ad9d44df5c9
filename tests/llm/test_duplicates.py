"""The Jaccard join and the containment search against all pairs in plain Python."""

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from abacist.llm import containment, partition_join
from abacist.llm.components import components
from abacist.llm.tables import Tables


def corpus(seed, families=12, copies=9, size=(3, 160)):
    """Families of edited copies, exact copies, shared passages, short texts, rows without text or id."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(700)]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    texts = ["", None, " \n ", "one", "one two", "One  TWO", "one two three", "a b c d", "a b c d"]
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*size))]
        if rng.random() < 0.5:
            base[5:5] = passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                at = rng.randrange(len(text))
                text[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1) or [text[at]]
            texts.append(" ".join(text))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "width", "p", "q"), [(1, 3, 90, 100), (2, 5, 8, 10), (3, 3, 8, 10)])
def test_components_are_those_of_all_pairs(spark, seed, width, p, q):
    rows = corpus(seed)
    sets = {i: plain.shingles(t, width) for i, t in rows}
    want = {(i, len(sets[i]), c) for i, c in plain.components(sets, p, q).items()}
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n long")
    assert {tuple(r) for r in partition_join.jaccard_join(docs, width, p, q).collect()} == want


def family(rng, size, copies, edits, chain=0.5):
    """Copies of one text with edits, some of them of the copy before: chains whose ends are far apart."""
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(size)]
    texts, last = [], base
    for _ in range(copies):
        text = list(last if rng.random() < chain else base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        texts.append(" ".join(text))
        last = text
    return texts


@pytest.mark.parametrize(("seed", "chunk", "width", "p", "q"), [(1, 2000, 5, 8, 10), (2, 900, 3, 90, 100), (3, 1 << 19, 5, 8, 10)])
def test_groups_of_several_chunks(spark, monkeypatch, seed, chunk, width, p, q):
    """A family of 500 near copies in chains and two smaller ones that share a passage: chunks, samples, smaller groups."""
    monkeypatch.setattr(partition_join, "CHUNK_ELEMENTS", chunk)
    monkeypatch.setattr(partition_join, "SAMPLE_SETS", 6)
    rng = random.Random(seed)
    texts = family(rng, 70, 500, 3) + family(rng, 60, 120, 2) + family(rng, 90, 120, 5, 0.8)
    passage = " ".join(f"p{i}" for i in range(25))
    texts += [f"{passage} " + " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 60))) for _ in range(150)] + ["x " * 20_000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sets = {i: plain.shingles(t, width) for i, t in rows}
    want = {(i, len(sets[i]), c) for i, c in plain.components(sets, p, q).items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {tuple(r) for r in partition_join.jaccard_join(docs, width, p, q).collect()} == want


@pytest.mark.parametrize(("p", "q"), [(8, 10), (90, 100), (1, 2), (1, 1)])
def test_links_connect_what_is_similar(p, q):
    rng = random.Random(p)
    for _ in range(60):
        base, sets = rng.sample(range(400), rng.randint(1, 60)), []
        for _ in range(rng.randint(1, 30)):
            x = set(base) if rng.random() < 0.7 else set(rng.sample(range(400), rng.randint(1, 60)))
            x -= set(rng.sample(sorted(x), rng.randint(0, len(x) // 5)))
            sets.append(x | set(rng.sample(range(400), rng.randint(0, 6))) or {1})
        want = plain.components(dict(enumerate(map(frozenset, sets))), p, q)
        top = list(range(len(sets)))
        for i, j in partition_join.links([np.array(sorted(x), np.uint64) for x in sets], p, q):
            assert q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])
            a, b = top[i], top[j]
            top = [min(a, b) if t in (a, b) else t for t in top]
        assert dict(enumerate(top)) == want


def test_one_of_each_with_clashing_columns(spark):
    rows = [(2, "a b c d e f", *"wxyz"), (1, "A b c d e f", *"stuv"), (3, "long " * 200_000, *"abcd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy_id string, copy_of string, copy_own string, copy_set string")
    got = partition_join.one_of_each(docs)
    assert got.columns == docs.columns and sorted(tuple(r)[0] for r in got.collect()) == [1, 3]


def test_one_of_each_keeps_the_smallest(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "x y z"), (5, "x y z"), (None, "x y z"), (None, "p q r s t u"),
            (None, "p q r s t u"), (None, None)]
    kept = partition_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, "a b c d e f g"), (3, None), (4, ""), (5, "x y z"), (None, "p q r s t u")], key=repr)


def test_texts_of_one_id_are_judged_each_by_its_own(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, one), (7, one + " more"), (7, two), (7, three), (8, two + " more"), (9, three + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in partition_join.jaccard_join(docs).collect())
    assert got == [(1, 1, 56), (7, 1, 57), (7, 7, 56), (7, 7, 56), (8, 7, 57), (9, 7, 57)]
    rows = [(1, one), *[(5, one)] * 8, (5, two), *[(5, one + " more")] * 8]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, partition_join.one_of_each(docs).collect())) == [(1, one), (5, two)]


def test_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert partition_join.jaccard_join(none).collect() == [] and partition_join.one_of_each(none).collect() == []


@pytest.mark.parametrize(("p", "q"), [(90, 100), (8, 10), (1, 1)])
def test_similar_sets_share_a_signature(p, q):
    rng = np.random.default_rng(p)
    index, met = partition_join.Partitions(p, q, np.zeros(0, np.uint64)), 0
    for _ in range(700):
        size = int(rng.choice([rng.integers(1, 12), rng.integers(5, 60), rng.integers(30, 700)]))
        x = np.unique(rng.integers(0, 2**64, size=size, dtype=np.uint64))
        most = partition_join.difference(len(x), p, q)
        less = int(rng.integers(0, most + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[less:], rng.integers(0, 2**64, size=int(rng.integers(0, most - less + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or q * both < p * (len(x) + len(y) - both):
            continue
        index.common = np.sort(rng.permutation(np.concatenate([x, y]))[:int(rng.integers(0, 2 * len(x)))]) if rng.random() < 0.5 else np.zeros(0, np.uint64)
        met += 1
        assert len(np.intersect1d(index.signatures(x), index.signatures(y)))
    assert met > 300


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "test"), "t").collect()
    assert {(r.node, r.component) for r in found} == {(i, 100) for i in range(100, 141)} | {(500 + i, 500) for i in range(60)}


def test_containment_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 40)))) for i in range(25)] + [(25, None), (26, ""), (27, "tiny Item"),
                                                                                                               (3, "a second text of one item id")]
    docs = []
    for i in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([5, 60, 900]))]
        part = (rng.choice(items)[1] or "").split()
        cut = rng.randint(0, max(0, len(part) // 4))
        text[3:3] = [w.upper() + "," for w in part[cut:]]
        docs.append((i if i % 20 else None, " ".join(text) if i % 17 else None))
    docs += [(200, "TINY item!"), (201, "tiny item"), (201, "tiny item")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {t for _, t in docs if any(plain.contained(t, x) for _, x in items)}
    assert len(bad) > 20
    clashing = frame.withColumns({c: F.lit("own") for c in ("text_key", "hash", "serves", "item_id", "item_key", "place")})
    kept = containment.decontaminate(clashing, bench.withColumns({c: F.lit(1) for c in ("doc_id", "text_key", "hash", "band", "place")}))
    assert kept.columns == clashing.columns and {r.text_key for r in kept.collect()} == {"own"}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([d for d in docs if d[1] not in bad], key=repr)
    hits = {(r.text_key, r.item_id) for r in containment.contaminated(frame, bench, Tables(spark, "test")).collect()}
    assert len(hits) == len({(t, i) for t in bad for i, x in items if plain.contained(t, x)})


def test_short_items_in_a_very_long_text_and_sizes_apart(spark):
    """Items of one shingle and of thousands lie in bands of their own; a text of a million words holds one of each."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    items = [(1, "five words are one shingle"), (2, " ".join(long[5000:9000])), (3, "not in any of the texts"), (4, " ".join(f"z{i}" for i in range(3000)))]
    text = " ".join(long[:150_000]) + " Five words, are one -- shingle " + " ".join(long[150_000:])
    docs = spark.createDataFrame([(1, text), (2, "five words are one"), (3, text[:20_000])], "doc_id long, text string")
    found = containment.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), Tables(spark, "test")).collect()
    assert {r.item_id for r in found} == {1, 2} and len({r.text_key for r in found}) == 1


def test_containment_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert containment.decontaminate(docs, none).count() == 1
    assert containment.decontaminate(docs.where("false"), none).count() == 0


def test_containment_is_native(spark):
    plan = containment.op8_benchmark_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_parities_refuse_no_linked_set():
    """Sets of one group at all distances, some with parities of other lengths: all with a partner stay, most without go."""
    rng, least = np.random.default_rng(5), 0
    for p, q in ((8, 10), (90, 100)):
        sets = []
        for size in (3, 60, 64, 66, 250, 600, 1000, 1030):
            base = partition_join.mix(rng.integers(0, 1 << 62, size).astype(np.uint64))
            for changed in (0, size // 30, size // 8, size // 3):
                new = partition_join.mix(rng.integers(0, 1 << 62, changed + size // 40).astype(np.uint64))
                sets.append(np.unique(np.concatenate([base[changed:], new])))
        sets.sort(key=len)
        near = [[i != j and q * len(np.intersect1d(a, b)) >= p * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
        want = np.array(near).any(axis=1)
        got = partition_join.plausible(np.array([len(x) for x in sets]), [partition_join.parity(x) for x in sets], p, q)
        assert got[want].all()
        least += int((~got).sum())
    assert least >= 20


def test_sets_that_only_meet_do_not_move(spark, monkeypatch):
    """Different texts around one passage share signatures; their sets were sent to their common groups all the same."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"w{rng.randrange(100_000)}" for _ in range(60)) for _ in range(60)]
    texts += [texts[0] + " more", texts[1] + " more"]
    moved, resolved = [], partition_join._resolved

    def counting(members, *rest):
        moved.append(members.select("node").distinct().count())
        return resolved(members, *rest)

    monkeypatch.setattr(partition_join, "_resolved", counting)
    monkeypatch.setattr(partition_join, "common_shingles", lambda docs, width: np.zeros(0, np.uint64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in partition_join.jaccard_join(docs, 5, 8, 10).collect()}
    assert found == {**{i: i for i in range(60)}, 60: 0, 61: 1}
    assert moved[0] <= 8


def test_large_groups_stay_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(partition_join, "PARITY_SETS", 2)
    rows = corpus(6)
    sets = {i: plain.shingles(t, 3) for i, t in rows}
    want = {(i, len(sets[i]), c) for i, c in plain.components(sets, 8, 10).items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in partition_join.jaccard_join(docs, 3, 8, 10).collect()} == want
