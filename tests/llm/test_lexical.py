"""Ranked search against brute force: copies, ties, odd rows, blocks of items, vocabularies that are joined."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import lexical
from cohortlens.llm.lexical import bags, classes, search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, top=10):
    """(item, rank, score) and the documents allowed there, ties by ascending id with NULL last."""
    bags_ = [(one, Counter(terms(t))) for one, t in rows]
    N, L = sum(bool(b) for _, b in bags_), sum(b.total() for _, b in bags_)
    df = Counter(t for _, b in bags_ for t in b)
    out = []
    for item, text in items:
        own, found = Counter(terms(text)), []
        for one, b in bags_:
            n = b.total()
            if n:
                m = 100 - 75 + (75 * n * N) // L
                score = sum(times * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m))
                            for t, times in own.items() if b[t])
                if score > 0:
                    found.append((-score, one is None, one or 0, one))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:top])]
    return Counter(out)


@pytest.fixture(scope="module")
def table(spark, docs, texts):
    """The odd rows, and groups of copies with ids that interleave."""
    base = docs.select("doc_id", "text")
    copies = spark.range(200).select(F.pmod(F.col("id") * 37, F.lit(200)).alias("doc_id"), F.element_at(
        F.array(*(F.lit(t) for t in ("alpha beta beta gamma", "beta alpha, GAMMA beta!", "alpha delta", "delta x1 alpha"))),
        (F.col("id") % 4 + 1).cast("int")).alias("text"))
    return base.unionByName(copies).withColumn("score", F.lit("clash")).repartition(5).cache()


@pytest.fixture(scope="module")
def items(spark, texts):
    return spark.createDataFrame([
        (1, "Alpha alpha beta"), (2, "delta"), (3, None), (4, "..."), (5, "no such terms qqq"), (6, texts[14]), (7, texts[8][:300]),
        (8, "nd x é 東京"), (2, "delta"), (9, "alpha beta gamma delta x1 x1")], "item_id long, text string")


@pytest.mark.parametrize("more", [{}, {"vocabulary_bytes": 0}, {"block_pairs": 10}, {"top": 3}, {"top": 1000}])
def test_search_equals_brute_force(table, items, more, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_CLASSES", 3)
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    want = brute(rows, {tuple(r) for r in items.collect()}, more.get("top", 10))
    assert Counter(tuple(r) for r in search(table, items, **more).collect()) == want


def test_copies_are_one_class(table, items, spark):
    vocabulary = spark.createDataFrame([("alpha", 5), ("beta", 2), ("delta", 9)], "term string, term_id long")
    held = bags(table.where("text LIKE '%lpha%'"), vocabulary, "doc_id", "text")
    got = {(tuple(r["ids"]), tuple(r["tfs"])): r["members"] for r in classes(held, 200, 750, 4).collect()}
    # one more term of length three, outside the vocabulary, parts the classes by their norm only if it changes
    assert set(got) == {((2, 5), (2, 1)), ((5, 9), (1, 1))}
    every = defaultdict(list)
    for one, text in table.where("text LIKE '%lpha%'").select("doc_id", "text").collect():
        every["beta" in text].append(one)
    assert got[(2, 5), (2, 1)] == sorted(every[True])[:4]


def test_nothing_to_find(table, items, empty):
    assert search(empty, items).isEmpty()
    assert search(table, items.limit(0)).isEmpty()
    assert search(table, items.where("item_id IN (3, 4, 5)")).isEmpty()
