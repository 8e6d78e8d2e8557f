"""Publishing several tables at once: readers stay on the old version, probes that fail change nothing, two writers, untouched tables, the report."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import publish as P

COMPANY, JOB = "id string, name string, description string", "id string, company_id string, title string"


@pytest.fixture
def stand(spark, tmp_path):
    p = P.Publication(spark, f"file://{tmp_path}/published")
    assert p.current() is None and p.read() == {}
    first = p.stage({"companies": spark.createDataFrame([("a", "Ely", "old words"), ("b", "Elko", "")], COMPANY), "jobs": spark.createDataFrame([("j1", "a", "Teller")], JOB), "runs": spark.range(3)})
    assert p.current() is None and p.read() == {}  # staged is not current
    assert p.publish(first, PROBES) == 1
    return p


PROBES = {
    "ids": P.unique("companies", "id"), "parents": P.references("jobs", "company_id", "companies", "id"), "cascade": P.cascade("companies", "id", {"jobs": "company_id"}), "some": P.at_least("companies", 2),
}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(spark, companies, jobs):
    return {"companies": (spark.createDataFrame(companies, COMPANY), "id"), "jobs": (spark.createDataFrame(jobs, JOB), "id")}


def test_a_migration_is_one_step(spark, stand):
    old = stand.read()
    mine = plan(spark, [("a", "Ely Bank", None), ("c", "Carson", "new")], [("j2", "c", "Cook"), ("j1", "a", "Teller")])
    assert rows(P.report(old, mine)) == [("companies", "create", 1), ("companies", "update", 1), ("jobs", "create", 1), ("jobs", "unchanged", 1)]
    assert P.migrate(stand, mine, {"companies": ("description",)}, PROBES) == 2
    now = stand.read()
    assert rows(now["companies"]) == [("a", "Ely Bank", "old words"), ("b", "Elko", ""), ("c", "Carson", "new")] and rows(now["jobs"]) == [("j1", "a", "Teller"), ("j2", "c", "Cook")]
    assert rows(now["runs"]) == [(0,), (1,), (2,)] and stand.manifest()["tables"]["runs"]["version"] == 1 and stand.manifest()["tables"]["jobs"]["rows"] == 2
    assert rows(old["jobs"]) == rows(stand.read(1)["jobs"]) == [("j1", "a", "Teller")]  # who read before stays there


def test_a_failing_probe_changes_nothing(spark, stand):
    before = {k: rows(v) for k, v in stand.read().items()}
    for bad, what in ((plan(spark, [], [("j9", "nowhere", "x")]), "nowhere"), (plan(spark, [("z", "1", ""), ("z", "2", "")], []), "'z'")):
        with pytest.raises(P.Rejected, match=what):
            P.migrate(stand, bad, {}, PROBES)
        assert stand.current() == 1 and {k: rows(v) for k, v in stand.read().items()} == before
    with pytest.raises(P.Rejected, match="2 rows without a title"):
        stand.publish(stand.stage({"jobs": spark.createDataFrame([("1", "a", ""), ("2", "a", None), ("3", "b", "x")], JOB)}), {"t": P.holds("jobs", F.col("title") != "", "a title")})


def test_two_writers(spark, stand):
    one, two = (stand.stage({"jobs": spark.createDataFrame([(k, "a", "x")], JOB)}) for k in ("one", "two"))
    assert one.number != two.number and one.base == two.base == 1
    assert stand.publish(two, PROBES) == 2
    with pytest.raises(P.Conflict):
        stand.publish(one, PROBES)
    assert rows(stand.read()["jobs"]) == [("two", "a", "x")]
