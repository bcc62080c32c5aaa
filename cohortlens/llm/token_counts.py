"""Token counts of a byte-pair vocabulary by merging with a heap and a linked list.

A text's symbols are its characters. The heap holds the rank and place of every adjacent pair that is in the
vocabulary; the pair of lowest rank (of equal ones the leftmost) is popped and merged, the links of its
neighbours are mended, and the two new pairs go into the heap. Each merge takes one token away, so the count is
the number of symbols at the start less the merges, and no token is ever looked up. A character without a token
of its own stands for as many byte tokens as its UTF-8 form has bytes.

No piece of such a vocabulary has the blank mark behind another character. So nothing merges across the place
before a run of blank marks: texts fall into runs there, whose counts add up, and equal runs are merged once.

Defined results: a NULL text counts as empty and has no tokens; control pieces written in a text are plain text,
as in the library; ties go left; repeated rows are counted each; texts of any length are read whole, a run
without blanks takes some 200 bytes of memory per character; an empty table gives an empty result; input columns
stay in ``row``.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructType

from cohortlens.llm.arrays import map_texts, text_bytes

MARK = "▁"
#: Characters of runs that a worker remembers the counts of.
REMEMBERED = 1 << 23


def read_pieces(path: str) -> tuple[dict[str, int], bool]:
    """Rank of each piece that merges can make, and whether texts get a blank mark in front.

    Only what this module reproduces is accepted: byte-pair models with byte fallback, texts taken as they are,
    no user-defined pieces.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
    pieces = [p for p in model.pieces if p.type not in (kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE)]
    texts = {p.piece for p in pieces}
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError(f"{path} is no byte-pair model with byte fallback")
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError(f"{path} changes texts before it merges them")
    if any(p.type != kinds.NORMAL for p in pieces) or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path} has pieces that are not made by merges alone")
    if not set().union(*texts) <= texts:
        raise ValueError(f"{path} merges characters that are no pieces")
    order = {score: rank for rank, score in enumerate(sorted({p.score for p in pieces}, reverse=True))}
    return {p.piece: order[p.score] for p in pieces}, spec.add_dummy_prefix


def merges(symbols: str, ranks: dict[str, int]) -> int:
    """How many merges the characters of ``symbols`` go through."""
    rank_of, n = ranks.get, len(symbols)
    bits = n.bit_length()  # an entry of the heap: the rank, then the place in so many bits
    place = (1 << bits) - 1
    heap = [r << bits | i for i, r in enumerate(map(rank_of, map(str.__add__, symbols, symbols[1:]))) if r is not None]
    if not heap:
        return 0
    heapify(heap)
    parts, after, before, done = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        top = heappop(heap)
        i = top & place
        j = after[i]
        if j >= n or not parts[i] or rank_of(whole := parts[i] + parts[j]) != top >> bits:
            continue  # one of the two has been merged since
        done += 1
        parts[i], parts[j] = whole, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of(whole + parts[k])) is not None:
                heappush(heap, r << bits | i)
        if (h := before[i]) >= 0 and (r := rank_of(parts[h] + whole)) is not None:
            heappush(heap, r << bits | h)
    return done


class Counter(dict):
    """Tokens of each run met so far; forgets all of them when they hold too many characters."""

    def __init__(self, ranks: dict[str, int], prefix: bool):
        super().__init__()
        self.ranks, self.prefix, self.size = ranks, prefix, 0
        apart = all(MARK not in piece.lstrip(MARK) for piece in ranks)
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else r"(?s).+").findall

    def __missing__(self, run: str) -> int:
        odd = [c for c in run if c not in self.ranks]
        found = len(run) + len("".join(odd).encode()) - len(odd) - merges(run, self.ranks)
        self.size += len(run)
        if self.size > REMEMBERED:
            self.clear()
            self.size = len(run)
        self[run] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        return sum(map(self.__getitem__, self.runs(MARK + marked if self.prefix else marked)))


_LOADED: dict[str, Counter] = {}


def load(path: str) -> Counter:
    """Once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Counter(*read_pieces(path))
    return _LOADED[path]


def count_tokens(documents: DataFrame, path: str, limit: int, text: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns), ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``)."""
    fields = StructType().add("n_bytes", LongType()).add("n_tokens", LongType()).add("over_limit", BooleanType())

    def make():
        counter = load(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            found = np.fromiter(map(counter.count, texts.to_pylist()), np.int64, len(texts))
            return [pa.array(np.diff(text_bytes(texts)[1])), pa.array(found), pa.array(found > limit)]
        return work

    return map_texts(documents, text, fields, make, keep)
