"""Token counts against the library that the vocabulary belongs to."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cohortlens.llm import queries
from cohortlens.llm.token_counts import count_tokens, load, merges

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_odd_and_random_texts_equal_the_library(library):
    rng = random.Random(5)
    values = [" ", "  a", "a ", " " * 100, "\t\n x\n\n  y", "<s> </s> <unk> <0x41>", "a▁b▁▁c", "▁", "é́ 東京 🎉🎉 梦", "a" * 3000,
              "ab" * 2000, "　x\x00y", "ſ﷽", "1234567890" * 20, "=== ====    ----", "x" + " " * 17 + "y"]
    values += ["".join(rng.choice("ab  the\n ▁éing東12=<s>") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    counter = load(PATH)
    for value in values:
        assert counter.count(value) == len(library.encode(value)), value


def test_merges_like_a_scan():
    ranks = {"ab": 2, "bc": 1, "abc": 3, "aa": 0, "aaaa": 0, "a": 9, "b": 9, "c": 9}
    for run in ("abc", "aaaaa", "aaaaaaaa", "abcabc", "cab", "a", "", "cba"):
        parts, done = list(run), 0
        while True:
            found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            done += 1
        assert merges(run, ranks) == done, run


def test_counts_of_odd_rows(docs, empty, library):
    found = count_tokens(docs, PATH, 100).collect()
    want = Counter()
    for r in docs.collect():
        text = r["text"] or ""
        n = len(library.encode(text))
        want[r["doc_id"], len(text.encode()), n, n > 100] += 1
    assert Counter((r["row"]["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == want
    assert count_tokens(empty, PATH, 100).isEmpty()
    named = docs.withColumn("n_tokens", F.lit("clash"))
    assert {r["row"]["n_tokens"] for r in count_tokens(named, PATH, 100).collect()} == {"clash"}


def test_forgetting_changes_nothing(library, monkeypatch):
    from cohortlens.llm import token_counts

    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    counter = token_counts.Counter(*token_counts.read_pieces(PATH))
    for value in ("the cat and the cat and", "unbelievable words and unbelievable things"):
        assert counter.count(value) == len(library.encode(value))


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        load(str(tmp_path / "m"))


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_token_counts"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for one, text in rows:
        n = len(library.encode(text or ""))
        assert got[one] == (len((text or "").encode()), n, n > 4096)
