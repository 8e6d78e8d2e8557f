"""Registered domains: the suffix list's own checks, its sections, odd hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import domains

#: Rules and results as the public suffix list states them for its users' checks.
RULES = """// ===BEGIN ICANN DOMAINS===
biz
com
uk.com // a comment behind

ac
jp
*.kobe.jp
!city.kobe.jp
kyoto.jp
ide.kyoto.jp
ac.jp
*.mm
*.ck
!www.ck
us
ak.us
k12.ak.us
公司.cn
cn
com.cn
uk
co.uk
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
blogspot.com
// ===END PRIVATE DOMAINS==="""
CHECKS = {
    "COM": "com", "example.COM": "example.com", "WwW.example.COM": "example.com", "example": "example", "example.example": "example.example", "b.example.example": "b.example.example",
    "biz": "biz", "domain.biz": "domain.biz", "a.b.domain.biz": "domain.biz", "uk.com": "uk.com", "example.uk.com": "example.uk.com", "b.example.uk.com": "example.uk.com", "mm": "mm", "c.mm": "c.mm", "b.c.mm": "b.c.mm", "a.b.c.mm": "b.c.mm",
    "test.jp": "test.jp", "www.test.jp": "test.jp", "ac.jp": "ac.jp", "test.ac.jp": "test.ac.jp", "www.test.ac.jp": "test.ac.jp", "kyoto.jp": "kyoto.jp", "test.kyoto.jp": "test.kyoto.jp", "ide.kyoto.jp": "ide.kyoto.jp", "b.ide.kyoto.jp": "b.ide.kyoto.jp",
    "c.kobe.jp": "c.kobe.jp", "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": "ck", "test.ck": "test.ck", "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck",
    "www.ck": "www.ck", "www.www.ck": "www.ck", "us": "us", "test.us": "test.us", "test.ak.us": "test.ak.us", "www.test.k12.ak.us": "test.k12.ak.us", "食狮.com.cn": "食狮.com.cn", "www.食狮.公司.cn": "食狮.公司.cn", "shishi.公司.cn": "shishi.公司.cn",
    "https://user:x@Jobs.bank.co.uk:8443/a.b.c?d.e": "bank.co.uk", "127.0.0.1": "127.0.0.1", "x.blogspot.com": "blogspot.com", "": "",
}


def test_the_lists_own_checks(spark, monkeypatch):
    lines = spark.createDataFrame(list(enumerate(RULES.split("\n"))), "at int, value string")
    urls = spark.createDataFrame([(u,) for u in CHECKS] + [(None,), ("biz",)], "u string").withColumns({c: F.lit("x") for c in ("host", "suffix", "n")})
    for most in (domains.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(domains, "MAX_BROADCAST_BYTES", most)
        got = domains.registered_domains(urls, F.col("u"), domains.read_rules(lines)).select("u", "registered_domain").collect()
        assert {r[0]: r[1] for r in got if r[0] is not None} == CHECKS and len(got) == len(CHECKS) + 2
        assert [r[1] for r in got if r[0] is None] == [""]
    private = domains.registered_domains(urls, F.col("u"), domains.read_rules(lines, private=True))
    assert private.where("u = 'x.blogspot.com'").first().registered_domain == "x.blogspot.com"
