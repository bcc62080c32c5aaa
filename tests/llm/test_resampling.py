"""Importance resampling against brute force, over odd rows, ties and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import resampling
from cohortlens.llm.resampling import drawn, ranked, resample, threshold

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, order):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute(rows, targets, percent, order=1, buckets=10_000, seed=2024, least=20):
    """(id, n_features, weight, score, words) of each row, and the drawn (score, id) in order."""
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, order)[1])

    s, t = counts([x for _, x in rows]), counts(targets)
    S, T = sum(s.values()), sum(t.values())
    out = []
    for one, text in rows:
        n, runs = features(text, order)
        total = 0
        for f in runs:
            b = zlib.crc32(f.encode()) % buckets
            total += math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
        weight = total // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if one is None else one}".encode()).hexdigest()[:8], 16)
        out.append((one, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted(((-r[3], r[0] is None, r[0] or 0) for r in out if r[4] >= least))
    chosen = able[:len(able) * percent // 100]
    return Counter(r[:4] for r in out), [(-a, None if b else c) for a, b, c in chosen]


@pytest.mark.parametrize("percent, order, buckets", [(10, 1, 10_000), (50, 2, 50), (100, 1, 70_000), (1, 3, 7)])
def test_resample_equals_brute_force(spark, docs, texts, percent, order, buckets, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 3)
    target = spark.createDataFrame([(texts[14],), (texts[19][:400],), (None,), ("",)], "text string")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want, chosen = brute(rows, [r[0] for r in target.collect()], percent, order, buckets)
    got = resample(docs, target, percent, order=order, buckets=buckets).collect()
    assert Counter((r["row"]["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == want
    ranks = sorted((r["rank"], r["score"], r["row"]["doc_id"]) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranks] == list(range(1, len(chosen) + 1))
    assert [r[1:] for r in ranks] == chosen


def test_no_documents_and_no_target(spark, docs, empty):
    target = spark.createDataFrame([("some text",)], "text string")
    assert resample(empty, target, 10).isEmpty()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = resample(docs, target.limit(0), 10).collect()
    assert Counter((r["row"]["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == brute(rows, [], 10)[0]
    assert resample(docs, target, 0).where("rank IS NOT NULL").isEmpty()
    with pytest.raises(ValueError):
        resample(docs, target, 10, keep=["text"])


def test_rows_carry_clashing_columns(docs, spark):
    target = spark.createDataFrame([("some text",)], "text string")
    found = resample(docs.withColumn("score", F.lit("clash")), target, 10).collect()
    assert {r["row"]["score"] for r in found} == {"clash"} and len(found) == docs.count()


@pytest.mark.parametrize("need", [1, 7, 100, 999, 1000])
def test_threshold_and_ranks_with_many_ties(spark, need):
    rows = spark.range(1000).select((F.col("id") % 7 - 3).alias("a"), (F.col("id") % 11 - (1 << 62)).alias("b"), F.col("id").alias("c"))
    every = sorted((tuple(r) for r in rows.collect()), reverse=True)
    assert threshold(rows, "a", need) == every[need - 1][0]
    taken = rows.where(drawn(rows, need, ("a", "b", "c")))
    assert sorted((tuple(r) for r in taken.collect()), reverse=True) == every[:need]
    got = sorted((r["rank"], r["a"], r["b"], r["c"]) for r in ranked(taken, 5 * resampling.RANGE_ROWS, ("a", "b", "c")).collect())
    assert got == [(i + 1, *x) for i, x in enumerate(every[:need])]
