"""Keyword containment and posting scores against plain Python and against the column cascade; blocks of keywords and resumes; odd rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewell.functions import rules as R
from tidewell.functions import text as T
from tidewell.operators import keywords


def test_containment_against_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcé", k=n))
    texts = [(i, " ".join(word(rng.randrange(1, 8)) for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [(200, None), (201, ""), (202, "abc" * 40_000)]
    known = [word(rng.randrange(1, 5)) for _ in range(60)] + ["abc", "abc", "", None, "zzz"]
    df = spark.createDataFrame(texts, "id int, text string").withColumns({c: F.lit("x") for c in ("row", "found", "k", "keyword")})
    kw = spark.createDataFrame([(k,) for k in known], "keyword string")
    want = {i: sorted({k for k in known if k and k in (x or "")}) for i, x in texts}
    for most in (keywords.BLOCK_BYTES, 300):
        monkeypatch.setattr(keywords, "BLOCK_BYTES", most)
        monkeypatch.setattr(keywords.blocks_of, "__defaults__", (most,))
        assert {r.id: r.found for r in keywords.contained(df, F.col("text"), kw).select("row.id", "found").collect()} == want
    assert all(r.found == [] for r in keywords.contained(df, F.col("text"), kw.limit(0)).collect())


def test_scores_equal_the_column_cascade(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["azure", "cloud", "risk", "asterisk", "teller", "branch", "remote", "security", "c++", "node.js", "Zürich", "experience", "sql", "credit union", "K8s", "the", "about", "would"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    posts = [(i, text(rng.randrange(0, 5)), text(rng.randrange(0, 90)), rng.choice(["Remote", "onsite", None])) for i in range(80)] + [(90, None, None, None), (91, "", "İ K ß x — \x1c y?z", "remote")]
    resumes = [("a", text(40) + " 12+ years of work"), ("b", text(3)), ("c", None)]
    df = spark.createDataFrame(posts, "id int, title string, body string, work string").withColumn("score", F.lit("x"))
    rs = spark.createDataFrame(resumes, "resume_id string, resume string")
    pairs = df.drop("score").crossJoin(F.broadcast(rs)).select("id", "resume_id", R.match(T.match_text("resume"), "title", "body", "work").alias("m")).select("id", "resume_id", "m.*")
    want = {(r.id, r.resume_id): (r.score, r.matched, r.missing, r.label) for r in pairs.collect()}
    for most in (keywords.BLOCK_BYTES, 64):
        monkeypatch.setattr(keywords.blocks_of, "__defaults__", (most,))
        got = keywords.score_postings(df, rs, work=F.col("work")).select("row.id", "resume_id", "score", "matched", "missing", "label").collect()
        assert {(r.id, r.resume_id): (r.score, r.matched, r.missing, r.label) for r in got} == want and len(got) == len(want)
    assert keywords.score_postings(df, rs.limit(0)).count() == 0 and keywords.score_postings(df.limit(0), rs).count() == 0
