"""The steps that narrow the Jaccard join's candidates lose no partner."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import bits
from cohortlens.llm.bits import flagged, narrowed, without
from cohortlens.llm.jaccard_join import DENOMINATOR, NUMERATOR, _bin, _keys, frequencies, join_sets, rare_parts

rng = np.random.default_rng(11)


@pytest.mark.parametrize("words", [1 << 20, 1])
def test_narrowed_and_without_are_exact_after_the_join(spark, monkeypatch, words):
    monkeypatch.setattr(bits, "WORDS", words)
    rows = spark.createDataFrame([(i % 700 if i % 50 else None, i) for i in range(2_000)], "k long, v int")
    table = spark.createDataFrame([(i,) for i in range(0, 700, 3)] + [(None,)], "k long")
    known = set(range(0, 700, 3))
    want = sorted((r.k, r.v) for r in rows.collect() if r.k in known)
    assert sorted(map(tuple, narrowed(rows, table, "k").join(table, "k").collect())) == want
    if words > 1:
        assert narrowed(rows, table, "k").count() < rows.count() / 2
    stay = without(rows, table, "k")
    assert stay.columns == rows.columns
    assert {r.v for r in stay.collect()} == set(range(2_000)) - {v for _, v in want}
    assert not flagged(rows, table.limit(0), "k").where("met").count()
    assert without(rows, table.limit(0), "k").count() == 2_000
    assert without(rows.limit(0), table, "k").isEmpty()


def _sets(spark, sets):
    rows = [(bytes(np.array([i, i * i], np.uint64).tobytes()), i % 2, s.tobytes()) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "id binary, class long, grams binary").repartition(3)


def test_counters_cover_every_holder(spark):
    passage = rng.integers(0, 2**63, 30, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**63, 20, dtype=np.uint64)])) for _ in range(40)]
    often = frequencies(_sets(spark, sets))
    assert often.sum() == sum(map(len, sets)) and (often[_bin(passage)] >= 40).all()
    assert not frequencies(_sets(spark, sets).limit(0)).any()


def test_linked_sets_share_a_rare_part(spark):
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 57, False), rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(30)]
    table = _sets(spark, sets)
    signed = rare_parts(frequencies(table))
    batch = table.toArrow().combine_chunks().to_batches()[0]
    ids, who, keys = signed(batch)
    held = [set(np.frombuffer(x, np.uint64).tolist()) for x in batch.column(2).to_pylist()]
    parts = [set(keys[who == k].tolist()) for k in range(len(held))]
    label = batch.column(1).to_pylist()
    linked = 0
    for a in range(len(held)):
        for b in range(a):
            if DENOMINATOR * len(held[a] & held[b]) >= NUMERATOR * len(held[a] | held[b]):
                linked += 1
                assert bool(parts[a] & parts[b]) == (label[a] == label[b])
    assert linked and (ids == _keys(np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16"))).all()


def test_documents_that_share_a_passage_only_stay_apart(spark):
    def prose(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))

    passage, twin = prose(60), prose(90)
    texts = [f"{prose(40)} {passage} {prose(10)}" for _ in range(20)] + [f"{passage} {twin}", f"{passage} {twin} tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block_sets in (1 << 13, 3):
        got = {r["row"]["doc_id"]: r["component_id"] for r in join_sets(docs, block_sets=block_sets).collect()}
        assert got == {**{i: i for i in range(21)}, 21: 20}


def test_a_planted_group_is_found_whole(spark):
    words = [f"g{x}" for x in rng.integers(0, 10**6, 200)]
    texts = [" ".join([*words[:i], "edit", *words[i + 1:]]) for i in range(60)] + [f"alone{i} " * 3 for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for block_sets in (1 << 13, 7):
        got = {r["row"]["doc_id"]: r["component_id"] for r in join_sets(docs, block_sets=block_sets).collect()}
        assert all(got[i] == 0 for i in range(60))
        assert all(got[60 + i] == 60 + i for i in range(30))
    assert docs.select(F.col("doc_id")).count() == 90


def test_sketches_lose_no_link_and_tell_others_apart():
    from cohortlens.llm.jaccard_join import alike, sketches
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 2, 3, 7, 12, 40, 130, 700):
        for _ in range(4):
            base = rng.integers(0, 2**63, size, dtype=np.uint64)
            for change in (0, max(1, size // 16), size // 9, size // 3):
                new = rng.integers(0, 2**63, rng.integers(0, change + 1), dtype=np.uint64)
                sets.append(np.unique(np.concatenate([base[:size - int(rng.integers(0, change + 1))], new])))
    sets = [s for s in sets if len(s)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    drawn = sketches(np.concatenate(sets), bounds)
    assert all(8 * len(x) >= max(128, len(s)) for x, s in zip(drawn, sets))
    root = dict(alike(np.array([len(s) for s in sets]), drawn))
    top = [root.get(k, k) for k in range(len(sets))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common):
                assert top[i] == top[j]
            elif not common and min(len(a), len(b)) >= 40:
                assert top[i] != top[j]
    # one without a sketch may link with all
    assert {r for _, r in alike(np.array([40, 900, 3]), [drawn[0], None, drawn[1]])} == {0}


def test_chance_meetings_do_not_join_classes(spark, monkeypatch):
    from cohortlens.llm import jaccard_join
    rng, held = random.Random(5), []
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    phrases = [words(8) for _ in range(20)]
    rows = []
    for i in range(400):  # every text has phrases of others, none is like another but for its near copy
        text = words(14) + rng.choice(phrases) + words(14) + rng.choice(phrases)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text + ["end"]))]
    join = jaccard_join._link_groups
    monkeypatch.setattr(jaccard_join, "_link_groups", lambda grouped: held.append(grouped.groupBy("task").count().collect()) or join(grouped))
    found = join_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["row"]["doc_id"]: r["component_id"] for r in found} == {i: i // 2 * 2 for i, _ in rows}
    assert max(r["count"] for r in held[0]) <= 4 and sum(r["count"] for r in held[0]) == len(rows)
