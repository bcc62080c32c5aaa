"""The registered queries of the operators, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.byte_bpe import encode_digest
from cohortlens.llm.decontaminate import decontaminate
from cohortlens.llm.html_text import extract
from cohortlens.llm.jaccard_join import join_sets
from cohortlens.llm.lexical import search
from cohortlens.llm.licenses import scan_licenses
from cohortlens.llm.quality import judge
from cohortlens.llm.resampling import resample
from cohortlens.llm.secrets import BASE, RULES, new_ledger, scan_versions, spans_of
from cohortlens.llm.shuffle import shuffle_rows, sized
from cohortlens.llm.suffix_dedup import remove_repeats
from cohortlens.llm.token_counts import count_tokens
from cohortlens.llm.warc import archive_folder, chunks, page_of, read_archives, records, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def vocabulary_path() -> str:
    """The vocabulary of the BPE queries; every executor has the file in its Python installation."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP1 = r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
        FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT doc_id, i, dw.m, item FROM dw JOIN bw USING (g, m)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query(_OP1)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


@query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_digest(table(spark, sf_dir, "documents"), vocabulary_path(), public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT h, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN f USING (h)
"""


@query(_OP5)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(chunks(records(pages)), archive_folder(spark))
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archives(manifest, data=False).select(
        page_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to", kind).alias("refers_to"))


@query()
def op8_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shuffle_rows(sized(table(spark, sf_dir, "documents")))
    return dealt.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query()
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_versions(table(spark, sf_dir, "documents"), new_ledger(spark), keep=["doc_id"])
    # a lambda of one parameter: a second one would be the place in the array
    count = [F.size(F.filter("findings", lambda f: f["rule"] == rule.name)).cast("long").alias(f"n_{rule.name}")
             for rule in RULES[:BASE]]
    return found.select("row.doc_id", *count, F.sha2(spans_of(F.col("findings"), RULES[:BASE]), 256).alias("base_sha256"),
                        spans_of(F.col("findings")).alias("spans"))


_OP4 = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, [y FOR y IN string_split_regex(x, '[\x20\x09-\x0D]+') IF y <> ''] AS w,
      [y FOR y IN string_split(x, chr(10)) IF regexp_matches(y, '[^\x20\x09-\x0D]')] AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
      CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_symbols / greatest(word_chars, 1) AS a, n_dup_lines / greatest(n_lines, 1) AS b,
      n_repeat_words / greatest(n_words, 1) AS c, n_capitals / greatest(word_chars, 1) AS d,
      word_chars / greatest(n_words, 1) AS e, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
q AS (SELECT lang, source, quantile_disc(a, 0.25) AS a1, quantile_disc(a, 0.75) AS a3, quantile_disc(b, 0.25) AS b1,
      quantile_disc(b, 0.75) AS b3, quantile_disc(c, 0.25) AS c1, quantile_disc(c, 0.75) AS c3, quantile_disc(d, 0.25) AS d1,
      quantile_disc(d, 0.75) AS d3, quantile_disc(e, 0.25) AS e1, quantile_disc(e, 0.75) AS e3 FROM s GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND a <= a3 + 6 * (a3 - a1) + 0.03::DOUBLE AND b <= b3 + 6 * (b3 - b1) + 0.35::DOUBLE
       AND c <= c3 + 6 * (c3 - c1) + 0.3::DOUBLE AND d <= d3 + 6 * (d3 - d1) + 0.15::DOUBLE
       AND e <= e3 + 6 * (e3 - e1) + 1 AND e >= e1 - 6 * (e3 - e1) - 1 AS kept
FROM s JOIN q ON s.lang IS NOT DISTINCT FROM q.lang AND s.source IS NOT DISTINCT FROM q.source
"""


@query(_OP4)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@query()
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", "n_chars")


@query()
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return cut.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query()
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_sets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return joined.select("row.doc_id", "n_shingles", "component_id")


@query()
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


#: Tokens that a training window holds.
TOKEN_LIMIT = 4096


@query()
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT,
                           keep=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


_OP12 = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
      FROM (SELECT unnest(range(0, 256)) AS i)),
d AS MATERIALIZED (SELECT doc_id, 'd' AS side, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents
      UNION ALL SELECT NULL, 'b', [x FOR x IN string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, side, word, count(*) AS n FROM (SELECT doc_id, side, unnest(w) AS word FROM d) GROUP BY ALL),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM f)),
y AS (SELECT word, list_prepend(4294967295, [16 * (instr('0123456789ABCDEF', x[2 * k + 1]) - 1)
      + instr('0123456789ABCDEF', x[2 * k + 2]) - 1 FOR k IN range(0, length(x) // 2)]) AS y FROM h),
b AS MATERIALIZED (SELECT word, xor(list_reduce(y, lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)])), 4294967295) % 10000 AS bucket
      FROM y, crc),
s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
      FROM f JOIN b USING (word) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS S_all, coalesce(sum(t), 0) AS T_all FROM s),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (S_all + 10000) / ((s + 1)::DOUBLE * (T_all + 10000)))) AS BIGINT) AS gain
      FROM s, a),
m AS (SELECT doc_id, sum(n * gain)::BIGINT AS total FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
z AS (SELECT doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE
      CAST(floor(total::DOUBLE / len(w)) AS BIGINT) END AS weight, sha256('2024:' || doc_id) AS x
      FROM d LEFT JOIN m USING (doc_id) WHERE side = 'd'),
o AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((list_reduce(list_prepend(0::BIGINT,
      [instr('0123456789abcdef', x[k]) - 1 FOR k IN range(1, 9)]), lambda c, v: 16 * c + v) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM z),
k AS (SELECT count(*) * 10 // 100 AS k FROM o WHERE n_features >= 20),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM o LEFT JOIN r USING (doc_id), k
"""


@query(_OP12)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, keep=["doc_id"])
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


_OP11 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, unnest([x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> '']) AS term FROM benchmark),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
st AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
f AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, st),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)) AS impact FROM f, st),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score FROM q JOIN i USING (term) JOIN w USING (term)
      GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query(_OP11)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
