"""The driver contract: entry() runs on sf0.001 with a stable schema."""

from __spark_entry__ import entry, oracle_sql, queries
from funnelkit.plans import registry


def test_entry_flagship(spark):
    df = entry(spark)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("stage", "string"),
        ("experts_reached", "bigint"),
        ("conversion_from_previous", "double"),
        ("conversion_from_signup", "double"),
    ]
    rows = df.collect()
    assert [r.stage for r in rows] == ["signup", "profile_started", "profile_completed", "verification_submitted",
                                       "verified", "activated"]
    assert rows[0].experts_reached == 1484  # FIXTURES.md C, sf0.001


def test_contract_keys():
    q, o = queries(), oracle_sql()
    reports = registry.queries()
    # the training-data queries and the pipeline are there if their package is
    assert len(reports) == 53 and set(reports) <= set(o) <= set(q)
    assert all(callable(f) for f in q.values())
