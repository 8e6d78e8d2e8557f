"""Pages that only the deduced template separates: neutral names, no article, chrome beside or among the text."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.llm import html_extract

NEUTRAL = "<html><body><div class='a1'><span>Daily Ledger</span><br>All the day's pages</div><div class='b2'><h1>Title {0}</h1><p>{1}</p><p>{2}</p></div><div class='c3'><p>Printed in the old town by the river</p></div></body></html>"
FLAT = "<html><body><div><p>Daily Ledger</p><p>Pages of the day</p><h1>Title {0}</h1><p>{1}</p><p>Pass this page on to others</p><p>{2}</p><p>Printed in the old town</p></div></body></html>"


def prose(seed: int, n: int = 40) -> str:
    return " ".join(f"word{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def pages(spark, form: str, n: int, host: str = "paper.example"):
    rows = [(k, f"http://{host}/{k}", form.format(k, prose(2 * k), prose(2 * k + 1))) for k in range(n)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.mark.parametrize("form", [NEUTRAL, FLAT])
def test_template_alone_separates(spark, form):
    df = pages(spark, form, 12)
    want = {k: f"Title {k}\n{prose(2 * k)}\n{prose(2 * k + 1)}" for k in range(12)}
    assert {r.page_id: r.text for r in html_extract.extract(df).select("row.page_id", "text").collect()} == want
    # without the slot and the template text, the chrome stays
    assert all("Daily Ledger" in html_extract.main_text(r.html) for r in df.collect())


def test_copies_show_no_template(spark):
    one = FLAT.format(1, prose(1), prose(2))
    df = spark.createDataFrame([(k, "http://copies.example/", one) for k in range(30)] + [(k, "http://copies.example/", FLAT.format(k, prose(k), prose(-k % 97))) for k in range(30, 32)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).select("row.page_id", "text").collect()}
    assert all(prose(1) in got[k] and prose(2) in got[k] for k in range(30)) and all(prose(k) in got[k] for k in (30, 31))


def test_a_sentence_with_template_words_stays(spark):
    form = "<html><body><div class='x'><p>By <b>Author {0}</b></p><p>{1}</p><p>{2}</p></div></body></html>"
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, form, 8)).select("row.page_id", "text").collect()}
    assert got == {k: f"By Author {k}\n{prose(2 * k)}\n{prose(2 * k + 1)}" for k in range(8)}


def test_few_pages_lose_nothing(spark):
    got = [r.text for r in html_extract.extract(pages(spark, FLAT, 2)).collect()]
    assert all(t.startswith("Daily Ledger\n") and t.endswith("Printed in the old town") for t in got)


def test_very_long_pages(spark):
    body = "<p>" + prose(3, 200_000) + "</p>"
    df = spark.createDataFrame([(1, "http://l.example/", f"<html><body>{'<div>' * 500}{body}</body></html>"), (2, "http://l.example/", "<" * 200_000), (3, None, "<!--" * 50_000)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).select("row.page_id", "text").collect()}
    assert got[1] == prose(3, 200_000) and got[3] == ""
