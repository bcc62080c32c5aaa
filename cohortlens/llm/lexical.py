"""Ranked lexical search of all documents for each of a set of items, over classes of equal bags.

A document is restricted to the items' vocabulary: what is left of it is a bag, the frequencies of those terms and
the length norm ``m``. Documents with the same bag get the same score for every item, so bags are hashed, grouped
and verified to be identical (the bag itself is part of the grouping), and each class is scored once. The classes
that are best for an item give their documents in ascending order of id: the ``top`` best classes, by score and least
id, hold the ``top`` best documents, and no more than the ``top`` least ids of a class can be among them.

Items go through in blocks of bounded size, one job per block over the classes; a task keeps the ``top`` classes of
each item of the block and nothing else. The vocabulary is broadcast below ``vocabulary_bytes``, beyond that
frequencies are joined to it.

Defined results: NULL and empty texts have no terms, such documents do not count in the statistics and such items find
nothing; equal scores go by ascending id, a NULL id last; repeated documents are ranked each; repeated rows of an item
count once, different texts under one id are items of their own; texts of any length are read whole; empty tables give
an empty result. Ids of documents are whole numbers; only the id is carried, so no column can clash.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from cohortlens.llm.arrays import lists, map_texts, ranges
from cohortlens.llm.terms import terms_of
from cohortlens.session import stage

#: A vocabulary up to this size is broadcast.
VOCABULARY_BYTES = 16 << 20
#: A block of items holds about so many (item, term) pairs ...
BLOCK_PAIRS = 1 << 18
#: ... and about so many items.
BLOCK_ITEMS = 1 << 14
#: Classes that are scored side by side.
BATCH_CLASSES = 1 << 13
_LAST = (1 << 63) - 1


def _pairs(table: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``row``, the number ``n`` of terms and the distinct ``terms`` with their frequencies ``tfs``."""
    fields = (StructType().add("n", LongType()).add("terms", ArrayType(StringType())).add("tfs", ArrayType(IntegerType())))

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            bags = [Counter(terms_of(x)) for x in texts.to_pylist()]
            sizes = np.fromiter(map(len, bags), np.int64, len(bags))
            tfs = np.fromiter(chain.from_iterable(b.values() for b in bags), np.int32, sizes.sum())
            terms = pa.array([t for b in bags for t in b], pa.binary()).cast(pa.string())
            return [pa.array([b.total() for b in bags], pa.int64()), lists(terms, sizes), lists(pa.array(tfs), sizes)]
        return work

    return map_texts(table, text, fields, make, keep)


def item_terms(items: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The distinct items with numbers, and (item number, term, frequency)."""
    numbered = stage(items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).distinct()
                     .withColumn("item_no", F.monotonically_increasing_id()))
    found = _pairs(numbered, "text", ["item_no"]).select("row.item_no", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return numbered.select("item_no", "item"), stage(found.select("item_no", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times")))


def bags(documents: DataFrame, vocabulary: DataFrame, key: str, text: str, limit: int = VOCABULARY_BYTES) -> DataFrame:
    """``doc``, the number ``n`` of its terms, and ascending ``ids`` and ``tfs`` of those in the vocabulary (staged)."""
    size, = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()
    doc = F.col(f"row.`{key}`").cast("long").alias("doc")
    if size > limit:
        counted = stage(_pairs(documents, text, [key]).withColumn("uid", F.monotonically_increasing_id()))
        met = (counted.select("uid", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
               .select("uid", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf")).join(vocabulary, "term"))
        bag = met.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("term_id", "tf"))).alias("bag"))
        joined = counted.select("uid", "row", "n").join(bag, "uid", "left")
        return stage(joined.select(doc, "n", F.coalesce("bag.term_id", F.array().cast("array<long>")).alias("ids"),
                                   F.coalesce("bag.tf", F.array().cast("array<int>")).alias("tfs")))
    table = vocabulary.toArrow()
    known = documents.sparkSession.sparkContext.broadcast(
        dict(zip(table["term"].cast(pa.binary()).to_pylist(), table["term_id"].to_pylist())))
    fields = StructType().add("n", LongType()).add("ids", ArrayType(LongType())).add("tfs", ArrayType(IntegerType()))

    def make():
        id_of = known.value.get
        wide = max(known.value.values(), default=0) + 1

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [np.fromiter(map(id_of, terms, repeat(-1)), np.int64, len(terms)) for terms in map(terms_of, texts.to_pylist())]
            n = np.fromiter(map(len, found), np.int64, len(found))
            numbers = np.concatenate([np.zeros(0, np.int64), *found])
            inside = numbers >= 0
            distinct, tfs = np.unique((np.repeat(np.arange(len(n)), n) * wide + numbers)[inside], return_counts=True)
            held, ids = np.divmod(distinct, wide)
            sizes = np.bincount(held, minlength=len(n))
            return [pa.array(n), lists(pa.array(ids), sizes), lists(pa.array(tfs.astype(np.int32)), sizes)]
        return work

    return stage(map_texts(documents, text, fields, make, [key]).select(doc, "n", "ids", "tfs"))


def classes(table: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """Classes of documents with the same bag and norm: ``m``, ``ids``, ``tfs``, the ``top`` least ids, the ``first`` of them."""
    m = F.expr(f"25L + (75L * n * {n_docs}L) div {n_terms}L")
    bag = ["hash", "m", "ids", "tfs"]
    rows = (table.where(F.size("ids") > 0).withColumn("m", m).withColumn("hash", F.xxhash64("ids", "tfs", "m")))
    order = Window.partitionBy(*bag).orderBy(F.col("doc").asc_nulls_last())
    least = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top)
    grouped = least.groupBy(*bag).agg(F.sort_array(F.collect_list(F.struct("at", "doc"))).alias("members"))
    return grouped.select("m", "ids", "tfs", F.col("members.doc").alias("members"),
                          F.coalesce(F.get("members.doc", F.lit(0)), F.lit(_LAST)).alias("first"))


class Block:
    """Items of one block: ``terms`` ascending; item ``i`` holds terms ``at[start[i]:start[i + 1]]`` with ``weight``."""

    def __init__(self, pairs: pa.Table, n_docs: int):
        item, term, times, df = (pairs[c].to_numpy() for c in ("item_no", "term_id", "times", "df"))
        weight = np.fromiter((math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()), np.int64, len(df))
        order = np.argsort(item, kind="stable")
        self.items, start = np.unique(item[order], return_index=True)
        self.start = np.append(start, len(item))
        self.terms, at = np.unique(term[order], return_inverse=True)
        self.at, self.weight = at, (weight * times)[order]

    def best(self, batches, top: int):
        """For each item the best classes of all batches: (-score, first, members)."""
        best: list[list[tuple]] = [[] for _ in self.items]
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_CLASSES):
                self._score(batch.slice(i, BATCH_CLASSES), best, top)
        return best

    def _score(self, batch: pa.RecordBatch, best: list[list[tuple]], top: int) -> None:
        m, ids, tfs, members, first = batch.columns
        m, first, sizes = m.to_numpy(), first.to_numpy(), ids.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(m)), sizes)
        ids, tf = ids.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        term = np.minimum(np.searchsorted(self.terms, ids), len(self.terms) - 1)
        met = np.flatnonzero(self.terms[term] == ids)
        met = met[np.argsort(term[met], kind="stable")]  # postings of the batch, by term
        row, tf = row[met], tf[met]
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        bounds = np.searchsorted(term[met], np.arange(len(self.terms) + 1))
        for i, held in enumerate(best):
            own = slice(self.start[i], self.start[i + 1])
            lo, count = bounds[self.at[own]], bounds[self.at[own] + 1] - bounds[self.at[own]]
            which = ranges(lo, count)
            score = np.zeros(len(m), np.int64)
            np.add.at(score, row[which], np.repeat(self.weight[own], count) * impact[which])
            least = -held[-1][0] if len(held) == top else 1
            found = np.flatnonzero(score >= least)
            if len(found) > top:
                found = found[score[found] >= np.partition(score[found], -top)[-top]]
                found = found[np.lexsort((first[found], -score[found]))[:top]]
            if len(found):
                held += [(-int(score[k]), int(first[k]), members[k].as_py()) for k in found.tolist()]
                held.sort(key=lambda x: x[:2])
                del held[top:]


def _searched(table: DataFrame, block: Block, top: int) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        found = shared.value.best(batches, top)
        rows = [(item, -score, first, members) for item, held in zip(shared.value.items.tolist(), found)
                for score, first, members in held]
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_no", "score", "first", "members"])

    return table.select("m", "ids", "tfs", "members", "first").mapInArrow(
        run, "item_no long, score long, first long, members array<long>")


def _nothing(spark: SparkSession, items: DataFrame) -> DataFrame:
    kind = items.schema["item"].dataType
    return spark.createDataFrame([], StructType().add("item", kind).add("rank", IntegerType()).add("doc", LongType()).add("score", LongType()))


def search(documents: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text", vocabulary_bytes: int = VOCABULARY_BYTES,
           block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``item``, ``rank`` (1 to ``top``), ``doc`` and ``score`` of the best documents of each item, scores above 0 only."""
    spark = documents.sparkSession
    numbered, asked = item_terms(items, item, item_text)
    vocabulary = stage(asked.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    table = bags(documents, vocabulary, key, text, vocabulary_bytes)
    n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = table.select(F.explode("ids").alias("term_id")).groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    pairs = stage(asked.join(vocabulary, "term").join(frequency, "term_id").select("item_no", "term_id", "times", "df"))
    n_pairs, n_items = pairs.agg(F.count(F.lit(1)), F.count_distinct("item_no")).first()
    if not n_pairs:
        return _nothing(spark, numbered)
    grouped = classes(table, n_docs, n_terms, top)
    blocks = max(-(-n_pairs // block_pairs), -(-n_items // BLOCK_ITEMS))
    if blocks == 1:
        found = _searched(grouped, Block(pairs.toArrow(), n_docs), top)
    else:
        grouped, number = stage(grouped), F.pmod(F.xxhash64("item_no"), F.lit(blocks))
        held = (pairs.where(number == b).toArrow() for b in range(blocks))
        found = reduce(DataFrame.unionByName, [stage(_searched(grouped, Block(part, n_docs), top)) for part in held if part.num_rows])
    by_class = Window.partitionBy("item_no").orderBy(F.col("score").desc(), "first")
    by_doc = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    expanded = (found.withColumn("at", F.row_number().over(by_class)).where(F.col("at") <= top)
                .select("item_no", "score", F.explode("members").alias("doc"))
                .withColumn("rank", F.row_number().over(by_doc)).where(F.col("rank") <= top))
    return expanded.join(numbered, "item_no").select("item", "rank", "doc", "score")
