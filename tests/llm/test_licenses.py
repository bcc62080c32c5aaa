"""Licence scans: every template, every place, and notices that differ by their version alone."""

import re

import pytest

from cohortlens.llm.license_templates import TEMPLATES
from cohortlens.llm.licenses import scan_licenses

EVERY = [(name, text) for name, texts in TEMPLATES.items() for text in texts]


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def scan(spark, texts):
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["row"]["doc_id"]: r["matches"] for r in rows}
    return [[tuple(m) for m in found[i]] for i in range(len(texts))]


def places(text, template):
    """Where the words of ``template`` stand in ``text``, by trying every place."""
    held, own = words(text), words(template)
    return [i for i in range(len(held) - len(own) + 1) if held[i:i + len(own)] == own]


def test_every_template_is_found_where_it_stands(spark):
    texts = [f"{'some prose goes before ' * (k % 9)}{t} and more follows it" for k, (_, t) in enumerate(EVERY)]
    for k, matches in enumerate(scan(spark, texts)):
        whole = {(m[1], m[4]) for m in matches if m[2] == m[3]}
        assert whole == {(j, at) for j, (_, t) in enumerate(EVERY) for at in places(texts[k], t)}
        assert (k, len(words(texts[k])) - len(words(EVERY[k][1])) - 4) in whole
        # what is found in part belongs to a licence that is found whole as well, or lies beside it
        name = EVERY[k][0]
        assert name in {m[0] for m in matches}


@pytest.mark.parametrize("gap", ["", " a few words between ", " word" * 500 + " "])
def test_every_place_is_returned(spark, gap):
    for name, notice in [("mit", TEMPLATES["mit"][0]), ("mit", TEMPLATES["mit"][2]), ("gpl-2.0", TEMPLATES["gpl-2.0"][1]),
                         ("bsd-3-clause", TEMPLATES["bsd-3-clause"][0])]:
        text = f"start {notice} {gap} {notice} {gap} {notice} end"
        matches = scan(spark, [text])[0]
        mine = [m for m in matches if (m[0], EVERY[m[1]][1]) == (name, notice)]
        assert [m[4] for m in mine] == places(text, notice) and all(m[2] == m[3] for m in mine)
        assert [m[5] - m[4] for m in mine] == [len(words(notice))] * 3
        assert {m[0] for m in matches} == {name}


def test_versions_are_told_apart(spark):
    names = ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "epl-1.0", "epl-2.0")
    found = scan(spark, [f"Before it. {TEMPLATES[n][-2]} After it." for n in names])
    assert [{m[0] for m in matches} for matches in found] == [{n} for n in names]
    clauses = f"{TEMPLATES['bsd'][0]}: one, two, three. {TEMPLATES['bsd-3-clause'][0]}"
    tags = ["SPDX-License-Identifier: BSD-2-Clause", "// SPDX-License-Identifier: GPL-2.0-or-later", "spdx license identifier mit"]
    assert [{m[0] for m in matches} for matches in scan(spark, [clauses, *tags])] == [
        {"bsd", "bsd-3-clause"}, {"bsd-2-clause"}, {"gpl-2.0"}, set()]


def test_missing_empty_and_repeated_rows(spark):
    notice = TEMPLATES["mit"][1]
    df = spark.createDataFrame([(1, None), (1, ""), (2, notice), (2, notice), (3, "four words are few")], "matches long, text string")
    got = sorted((r["row"]["matches"], len(r["matches"])) for r in scan_licenses(df, keep=["matches"]).collect())
    assert got == [(1, 0), (1, 0), (2, 1), (2, 1), (3, 0)]
