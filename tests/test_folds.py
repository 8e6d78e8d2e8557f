"""Order-dependent folds against plain loops: random orders, ties, keys cut into segments, a key with very many rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import discovery, merge, scans

COMPANY = "ord int, company_id string, company_name string, city string, state string, official_website string, careers_page_url string, job_board_url string, last_checked string, confidence int, notes string"
FIELDS = merge.COMPANY_COLUMNS


def fold(rows):
    """One company's rows, one after the other."""
    text = [tuple(v or "" for v in r[1:9]) + (r[9] or 0, r[10] or "") for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], *text[k]))
    best = dict(zip((*FIELDS, "confidence", "notes"), text[order[0]]))
    quality = lambda x: (x["job_board_url"] != "", x["careers_page_url"] != "", x["official_website"] != "", x["confidence"], x["last_checked"])
    for k in order[1:]:
        x = dict(zip((*FIELDS, "confidence", "notes"), text[k]))
        a, b = (x, best) if quality(x) > quality(best) else (best, x)
        notes = [n.strip(" ") for n in (best["notes"] + ";" + x["notes"]).split(";")]
        best = {c: a[c] or b[c] for c in FIELDS} | {"confidence": max(a["confidence"], b["confidence"]), "notes": "; ".join(dict.fromkeys(n for n in notes if n))}
    return (*best.values(), len(rows))


def company_rows(rng, n):
    some = lambda *v: rng.choice(["", None, *v])
    return [
        (rng.randrange(n), some("a", "b", "c"), "Ely", some("Rome", "Ely"), "CO", "", some("c1", "c2"), some("b1", "b2"), some("2024", "2023", "2022", "2021"), rng.choice([None, 0, 1, 2]), some("one", "two; one", " three ;"))
        for _ in range(n)
    ]


@pytest.mark.parametrize("hot", [False, True])
def test_company_fold_on_random_orders(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(scans, "HOT_ROWS", 6)
        monkeypatch.setattr(scans, "SEGMENTS", 5)
    rng, rows, want = random.Random(11), [], {}
    for k in range(60):
        mine = [(o, i, f"Ely{k}", *rest) for o, i, _, *rest in company_rows(rng, rng.randrange(1, 40))]
        rows += mine
        want[f"name-state:ely{k}:co"] = fold(mine)
    got = merge.fold_companies(spark.createDataFrame(rows, COMPANY).repartition(7), "ord").collect()
    assert {r.key: tuple(r[1:]) for r in got} == want and len(got) == 60
    assert merge.fold_companies(spark.createDataFrame([], COMPANY), "ord").count() == 0


def pick(rows):
    """One company's candidates (ord, url, score, confidence, verified), one after the other."""
    rank = {"High": 3, "Medium": 2, "Low": 1}
    kept = sorted(((o, rank.get(c, 0), s, u, c, v) for o, u, s, c, v in rows if c != "None" or s > 0))
    best = None
    for x in kept:
        if best is None or not (best[4] == "High" and best[5]) and (x[1] > best[1] or x[2] > best[2]):
            best = x
    return best and best[2:6]


@pytest.mark.parametrize("hot", [False, True])
def test_website_pick_on_random_orders(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(scans, "HOT_ROWS", 6)
        monkeypatch.setattr(scans, "SEGMENTS", 5)
    rng, rows, want = random.Random(12), [], {}
    for k in range(150):
        mine = [(rng.randrange(99), f"u{j}", rng.randrange(-5, 60), rng.choice(["High", "Medium", "Low", "None"]), rng.random() < 0.1) for j in range(rng.randrange(1, 40))]
        rows += [(f"c{k}", *x) for x in mine]
        if (best := pick(mine)) is not None:
            want[f"c{k}"] = best
    df = spark.createDataFrame(rows, "k string, ord int, url string, score int, confidence string, verified boolean").repartition(7)
    got = discovery.best_website(df, "k", "ord").select("k", "score", "url", "confidence", "verified").collect()
    assert {r.k: tuple(r[1:]) for r in got} == want and len(got) == len(want)


def test_a_key_with_a_million_rows(spark):
    i = F.col("id")
    df = spark.range(1_000_000).select(
        i.alias("ord"), i.cast("string").alias("company_id"), F.lit("Ely").alias("company_name"), F.lit("").alias("city"), F.lit("CO").alias("state"), F.lit("").alias("official_website"),
        F.when(i == 700_000, "c").otherwise("").alias("careers_page_url"), F.when(i >= 400_000, "b").otherwise("").alias("job_board_url"), F.date_format(F.date_add(F.lit("2000-01-01"), (i % 9000).cast("int")), "yyyy-MM-dd").alias("last_checked"),
        F.lit(5).alias("confidence"), F.lit("n").alias("notes"),
    )
    marked, hot = scans.segmented(df, "company_name", "ord")
    sizes = [r["count"] for r in marked.groupBy("_seg").count().collect()]
    assert hot and len(sizes) == scans.SEGMENTS and max(sizes) < 3 * 1_000_000 / scans.SEGMENTS
    r = merge.fold_companies(df, "ord").collect()
    # row 400,000 leads by its board, 700,000 by its careers page; from then on no row has both links
    assert len(r) == 1 and (r[0].company_id, r[0].careers_page_url, r[0].job_board_url, r[0].n_rows) == ("700000", "c", "b", 1_000_000)
