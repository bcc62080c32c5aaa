"""WARC archives, HTML extraction, byte-level BPE and the pipeline."""

import hashlib
import io
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import queries
from cohortlens.llm.byte_bpe import decode, encode, encode_digest, merge, read_ranks
from cohortlens.llm.html_text import extract, main_text
from cohortlens.llm.warc import archive_folder, chunks, page_of, parse, read_archives, records, write_archives

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# ---- WARC ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>ünï " * 40_000
    rows = [(1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, None, "x" * 1500), (3, "http://again", "x" * 1500),
            (4, "http://c\r\nWARC-Type: evil", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", "x" * 1500),
            (8, "u", big), (9, "u", big + "!"), (10, "u", "WARC/1.1\r\n\r\n" * 200)]
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def archived(spark, table, **more):
    manifest = write_archives(chunks(records(table), **more), archive_folder(spark))
    return manifest, read_archives(manifest)


def test_archives_round_trip(spark, pages):
    manifest, rows = archived(spark, pages, size=1000)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: r["chunk_no"]):
        got.setdefault((r["record_id"], r["target_uri"], r["record_type"], r["refers_to"]), []).append(r)
    assert manifest.agg(F.sum("n_records")).first()[0] == pages.count()
    whole = Counter()
    for (_, _, kind, _), parts in got.items():
        data = b"".join(p["data"] for p in parts if kind == "response")
        if kind == "response":
            digest = hashlib.sha1()
            for p in parts:
                digest.update(p["data"])
                assert p["payload_digest"] == digest.hexdigest()
            whole[data] += 1
    want = Counter((r["html"] or "").encode() for r in pages.collect())
    assert whole[b"x" * 1500] == 2 and {k: v for k, v in whole.items() if k != b"x" * 1500} == {
        k: v for k, v in want.items() if k != b"x" * 1500}


def test_archive_kinds(spark, pages):
    manifest, _ = archived(spark, pages)
    rows = read_archives(manifest, data=False).select(page_of("record_id", "long"), "record_type", page_of("refers_to", "long"), "payload_bytes")
    got = Counter(tuple(r) for r in rows.collect())
    assert {(1, "revisit", 3, 1500), (2, "revisit", 3, 1500), (None, "revisit", 3, 1500), (6, "response", None, 0)} <= set(got)
    assert got[(3, "response", None, 1500)] == 2 and got[(5, "response", None, 5)] == 1
    empty, rows = archived(spark, pages.limit(0))
    assert empty.isEmpty() and rows.isEmpty()


def test_reader_refuses_broken_archives(spark, pages):
    def member(text):
        c = zlib.compressobj(wbits=31)
        return c.compress(text) + c.flush()
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:x>\r\nWARC-Payload-Digest: sha1:%s\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    good = head % hashlib.sha1(b"abc").hexdigest().encode() + http + b"abc\r\n\r\n"
    assert [r[4] for r in parse(io.BytesIO(member(good) * 2))] == [3, 3]
    for bad in (good[:-6], good.replace(b"abc", b"abd"), good.replace(b"abc", b"abcd")):
        with pytest.raises(ValueError):
            list(parse(io.BytesIO(member(bad))))


# ---- HTML ---------------------------------------------------------------------------------------------

LONG = "A long, well-filled paragraph, with commas, that any article might hold."


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain", "plain"),
    (f"<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>Two\n  lines<br></article><footer>x</footer>", f"T & U\n{LONG}\nTwo lines"),
    (f"<header>Site</header><main><h1>T</h1><div class='ad'>Buy</div><p>{LONG}</p><ul><li>one<li>two</ul></main>", f"T\n{LONG}\none\ntwo"),
    (f"<div id=page><div class=content><p>{LONG}</p><p>ok</p></div><div class='user-comments'><p>{LONG}</p></div></div>", f"{LONG}\nok"),
    (f"<script>var a='</p><p>no';</script><style>p{{}}</style><form><p>{LONG}</p></form><article><p>a<b>b</b>c &#233;&lt;</article>", "abc é<"),
    ("<article><p>a < b and x>y</p><table><tr><td>1<td>2</table></article>", "a < b and x>y\n1\n2"),
    (f"<div><p>{LONG}</p><div hidden>no</div><div role='dialog'>no</div><aside>no</aside></div>", LONG),
])
def test_main_text(html, text):
    assert (main_text(html) if html else "") == text


@pytest.mark.parametrize("attributes", [
    'data-hidden="false"', 'title="The hidden cost"', 'data-id="comments"', "title='id=comments class=ad'", 'aria-hidden-x="true"'])
def test_names_inside_other_attributes_do_not_cut(attributes):
    assert main_text(f"<article><p>{LONG}</p><section {attributes}><p>Kept.</p></section></article>") == f"{LONG}\nKept."


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "data-x=1 hidden", 'title="a b" id = "comments"', "aria-hidden=true"])
def test_hidden_and_boilerplate_attributes_cut(attributes):
    assert main_text(f"<article><p>{LONG}</p><section {attributes}><p>Cut.</p></section></article>") == LONG


@pytest.mark.parametrize("around", ["<main>{}</main>", "<div>{}</div>", "<body>{}"])
def test_short_sections_stay_beside_a_long_one(around):
    page = f"<section>{f'<p>{LONG}</p>' * 30}</section><section><p>Short one.</p><p>And two</p></section>"
    assert main_text(around.format(page)).split("\n") == [LONG] * 30 + ["Short one.", "And two"]


def test_link_lists_beside_the_text_do_not_stay():
    assert main_text(f"<div><section><p>{LONG}</p></section><section><a href=/>Other</a> <a href=/>pages</a></section></div>") == LONG


@pytest.mark.parametrize("around", ["<section><h2>Replies</h2>{}</section>", "{}", "<div>{}</div>"])
@pytest.mark.parametrize("comment", [f"<article class='comment'><p>{LONG * 3}</p></article>", f"<article class='comment-body'><p>{LONG * 3}</p></article>",
                                     f"<article id=comment-12><p>{LONG * 3}</p></article>", f"<article hidden><p>{LONG * 3}</p></article>"])
def test_reader_comments_never_win(around, comment):
    page = around.format(comment * 3)
    assert main_text(f"<article><p>{LONG}</p><p>End.</p></article>{page}") == f"{LONG}\nEnd."
    assert main_text(f"<main><article><p>{LONG}</p><p>End.</p></article>{comment}</main>") == f"{LONG}\nEnd."
    assert main_text(f"<main><p>{LONG}</p><p>End.</p>{comment}</main>") == f"{LONG}\nEnd."


@pytest.mark.parametrize("name", ["class='notice-period'", "class='social-history'", "id='related-work'", "class='comment-free menu-planning'"])
def test_telling_names_in_an_article_do_not_cut(name):
    assert main_text(f"<article><p>Intro.</p><section {name}><p>{LONG}</p></section></article>") == f"Intro.\n{LONG}"


@pytest.mark.parametrize("name", ["class='share-buttons'", "class='x ad'", "id='newsletter-signup'", "class='relatedPosts'", "class='cookie-banner'", "class='ad-slot'"])
def test_boxes_of_boilerplate_in_an_article_are_cut(name):
    assert main_text(f"<article><p>{LONG}</p><div {name}><p>Buy this.</p></div><p>End.</p></article>") == f"{LONG}\nEnd."


def test_extract_reads_every_page(spark, pages):
    rows = extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert extract(pages.limit(0)).isEmpty()


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + f"<p>{LONG}</p>") == LONG
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 5000)) == 5000 * (len(LONG) + 1) - 1


# ---- byte-level BPE -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def odd_texts():
    return [None, "", " ", "  a", "a ", "a  b", "a\n b\n\nc ", "　x \x1c y\x85", "<|endoftext|>", "it's we'll I'D", "é́ 東京 🎉🎉",
            "a" * 3000, "ab" * 2000, "word" * 30, "x" * 65, "1234567 !!?? --", "nd, " * 500]


def test_encoding_equals_tiktoken(spark, texts, reference):
    values = odd_texts() + [t for t in texts if t and len(t) < 60_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(values)], "doc_id long, text string, ids int").repartition(3)
    coded = encode(df, PATH, PATTERN)
    assert coded.count() == len(values)
    back = decode(coded, PATH, PATTERN)
    for r in back.collect():
        text, ids = r["row"]["row"]["text"] or "", r["row"]["ids"]
        assert ids == reference.encode_ordinary(text)
        assert r["bytes"] == text.encode()
    for r in encode_digest(df, PATH, PATTERN).collect():
        ids = reference.encode_ordinary(r["row"]["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["row"]["text"] or "").encode()).hexdigest()
    assert encode(df.limit(0), PATH, PATTERN).isEmpty()


def test_patterns_that_do_not_break_at_blanks(spark, reference):
    plain = tiktoken.Encoding("other", pat_str=r"\w+|\W+", mergeable_ranks=read_ranks(PATH), special_tokens={})
    df = spark.createDataFrame([(1, "a b  c, d")], "doc_id long, text string")
    assert encode(df, PATH, r"\w+|\W+").first()["ids"] == plain.encode_ordinary("a b  c, d")


def test_segment_tree_merges_like_a_scan():
    ranks = read_ranks(PATH)
    for piece in (b"aaaaaaa", b"thethethe", b"\xff\xfe" * 9, b"zqzqzq", b"unhappiness" * 7):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        assert merge(piece, ranks) == [ranks[p] for p in parts]


# ---- queries and pipeline -----------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    from tools.check_queries import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_stages_keep_the_columns_of_documents(spark, docs, texts):
    frame = docs
    for name, work in corpus_pipeline.STAGES[:-1]:
        after = work(spark, frame, SF)
        assert after.columns == docs.columns, name
        assert work(spark, frame.limit(0), SF).isEmpty()
        assert after.count() <= frame.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and all(r["n_tokens"] == len(r["token_ids"]) for r in last)


def test_last_stage_refuses_clashing_columns(spark, docs):
    for name in ("token_ids", "N_TOKENS"):
        with pytest.raises(ValueError, match=name.lower()):
            corpus_pipeline.STAGES[-1][1](spark, docs.withColumn(name, F.lit(1)), SF)


def test_later_stages_delete_what_earlier_ones_staged(spark, docs, tmp_path):
    quality, duplicates = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[1][1]
    held = lambda: set(corpus_pipeline._LEFT[spark.sparkContext.applicationId][1])
    first = quality(spark, docs, SF)
    mine = held()
    second = duplicates(spark, first, SF)  # reads on from the staged rows, which must stay
    assert mine <= held() and second.count() <= first.count()
    first.write.parquet(str(tmp_path / "first"))
    rows = first.count()
    quality(spark, docs, SF)
    assert duplicates(spark, spark.read.parquet(str(tmp_path / "first")), SF).count() <= rows
    assert not mine & held()


def test_pipeline_takes_effect(spark):
    rows = corpus_pipeline.run(spark, SF)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    judged = queries.judge(table).where("kept").select("row.doc_id")
    assert 0 < rows.count() <= judged.count() < table.count()
    assert rows.join(judged, "doc_id", "left_anti").isEmpty()
