"""CSV source with explicit schemas, table sinks, the materialised build."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import SF0001
from funnelkit.plans.build import MARTS, build_all
from funnelkit.plans.models import Models
from funnelkit.operators.sessions import expert_sessions
from funnelkit.operators.staging import stg_experts
from funnelkit.sources.raw import read_csv_tables, read_parquet_tables, rejected_lines, write_raw
from funnelkit.sources.schemas import raw_schemas
from funnelkit.sources.tables import current_version, read_table, write_table


def test_csv_round_trip(spark):
    m = Models.from_testdata(spark, SF0001)
    base = tempfile.mkdtemp(prefix="funnelkit-csv-")
    write_raw(m.raw, base, fmt="csv")
    back = read_csv_tables(spark, base)
    for name, df in m.raw.as_dict().items():
        other = back.as_dict()[name]
        assert [(f.name, f.dataType) for f in other.schema] == [(f.name, f.dataType) for f in df.schema]
        assert df.exceptAll(other).count() == 0 and other.exceptAll(df).count() == 0


def test_build_all_writes_marts(spark):
    m = Models.from_testdata(spark, SF0001)
    out = tempfile.mkdtemp(prefix="funnelkit-marts-")
    built = build_all(spark, raw=m.raw, out_dir=out, run_tests=True)
    assert set(MARTS) <= set(built)
    for name in MARTS:
        stored = read_table(spark, f"{out}/{name}")
        assert stored.count() == built[name].count()
    report = {(r.check_name, r.table_name, r.column_name): r for r in read_table(spark, f"{out}/dq_report").collect()}
    assert len(report) == 36 + 11 + 8 + 2 + 4
    assert report[("timestamp_ordering", "stg_funnel_events", None)].failed  # the fixture has disorder
    assert report[("unique", "funnel_events", "event_id")].failing_rows == 20  # FIXTURES.md C
    assert report[("not_null", "stg_funnel_events", "stage_order")].failing_rows == 16
    assert report[("relationships", "funnel_events", "expert_id")].failing_rows == 63
    assert report[("accepted_values", "experts", "signup_source")].failed  # raw text is unclean by design
    assert not report[("accepted_values", "stg_experts", "signup_source")].failed
    fc = {r.stage: r.experts_reached for r in read_table(spark, f"{out}/mart_funnel_conversion").collect()}
    assert fc["signup"] == 1484  # FIXTURES.md C, sf0.001
    views = m.register_views("t_")
    assert "t_expert_sessions" in views
    assert spark.sql("SELECT count(*) FROM t_stg_funnel_events").first()[0] == 7500


def test_command_line_build(spark):
    from funnelkit.__main__ import main

    m = Models.from_testdata(spark, SF0001)
    raw = tempfile.mkdtemp(prefix="funnelkit-cli-raw-")
    out = tempfile.mkdtemp(prefix="funnelkit-cli-out-")
    write_raw(m.raw, raw, fmt="csv")
    main(["--raw", raw, "--out", out, "--format", "csv", "--test"])
    assert read_table(spark, f"{out}/mart_cohort_conversion").count() == 53
    assert read_table(spark, f"{out}/dq_report").count() == 61


CSV = {
    "experts": """expert_id,signup_date,signup_source,utm_campaign,utm_medium,utm_source,country,industry
a-1,2024-01-01 10:00:00 UTC," Paid ""Search"" ",c,,,US,tech
a-2,2024-01-02T01:30:00+02:00,organic,,,,"Korea, Republic of","x
",
""",
    "funnel_events": """event_id,expert_id,event_name,event_timestamp,event_properties
e-1,a-1,signup,2024-01-01 10:00:00.250000 UTC,"{""k"": ""v, w"", ""n"": [1]}"
e-2,a-1,profile_started,2024-01-01 12:00:00Z,""
,a-1,signup,2024-01-01 10:00:00,
e-3,a-1,signup,soon,
e-4,a-1
""",
    "engagements": """engagement_id,expert_id,engagement_type,engagement_date,payout_amount,client_industry
g-1,a-1,survey,2024-02-01,12.5,x
g-2,a-1,survey,2024-02-01,twelve,x
""",
    "daily_channel_spend": """date,channel,campaign_name,spend_usd,impressions,clicks
2024-03-01,Paid_Search,c,10.00,5,1
2024-03-02 00:00:00 UTC,Paid_Search,c,,5,1
2024-13-02,Paid_Search,c,1,5,1
""",
}


@pytest.fixture(scope="module")
def exported():
    base = tempfile.mkdtemp(prefix="funnelkit-export-")
    for name, text in CSV.items():
        with open(os.path.join(base, f"{name}.csv"), "w") as f:
            f.write(text.replace('"x\n",', "x"))
    return base


def test_csv_as_a_warehouse_exports_it(spark, exported):
    raw = read_csv_tables(spark, exported, key_type="string", rejects="skip")
    one, two = raw.experts.orderBy("expert_id").collect()
    assert (one.expert_id, one.signup_source, one.utm_medium) == ("a-1", ' Paid "Search" ', None) and str(one.signup_date) == "2024-01-01 10:00:00"
    assert str(two.signup_date) == "2024-01-01 23:30:00" and two.country == "Korea, Republic of"
    a, b = raw.funnel_events.orderBy("event_id").collect()
    assert a.event_properties == '{"k": "v, w", "n": [1]}' and a.event_timestamp.microsecond == 250_000
    assert b.event_properties == "" and str(b.event_timestamp) == "2024-01-01 12:00:00"
    assert [str(r.payout_amount) for r in raw.engagements.collect()] == ["12.50"]
    assert [(str(r.date), r.spend_usd is None) for r in raw.daily_channel_spend.orderBy("date").collect()] == [("2024-03-01", False), ("2024-03-02", True)]


def test_rejected_lines_have_a_reason(spark, exported):
    got = sorted((r.table_name, r.reason, r.line) for r in rejected_lines(spark, exported, key_type="string").collect())
    assert [(t, why) for t, why, _ in got] == [
        ("daily_channel_spend", "date is no date: 2024-13-02"),
        ("engagements", "payout_amount is no decimal(18,2): twelve"),
        ("funnel_events", "event_id is missing"),
        ("funnel_events", "event_timestamp is no timestamp_ntz: soon"),
        ("funnel_events", "not a line of 5 fields"),
    ]
    assert got[-1][2] == "e-4,a-1" and rejected_lines(spark, exported).where("reason LIKE 'expert_id is no bigint%'").count() > 0
    with pytest.raises(Exception, match="payout_amount is no decimal"):
        read_csv_tables(spark, exported, key_type="string").engagements.collect()


def test_string_keys_through_the_models(spark):
    m = Models.from_testdata(spark, SF0001)
    keys = lambda df: df.select([F.concat(F.lit("k"), c.cast("string")).alias(n) if n in ("expert_id", "event_id", "engagement_id") else c.alias(n)
                                 for n, c in ((n, F.col(n)) for n in df.columns)])
    base = tempfile.mkdtemp(prefix="funnelkit-keys-")
    named = type(m.raw)(**{n: keys(df) for n, df in m.raw.as_dict().items()})
    write_raw(named, f"{base}/csv", fmt="csv")
    write_raw(named, f"{base}/parquet")
    one, two = Models(read_csv_tables(spark, f"{base}/csv", "string")), Models(read_parquet_tables(spark, f"{base}/parquet", "string"))
    assert one.raw.experts.schema["expert_id"].dataType == raw_schemas("string")["experts"]["expert_id"].dataType
    for a, b in ((one.stg_experts, two.stg_experts), (one.stg_funnel_events, two.stg_funnel_events), (one.stg_engagements, two.stg_engagements)):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert stg_experts(named.experts).count() == 1500
    sizes = lambda s: sorted(s.groupBy("events_in_session").count().collect())
    # ties are broken by the event's key, whose order differs as text, but not what is in a session
    assert sizes(expert_sessions(one.stg_funnel_events)) == sizes(m.expert_sessions)


def test_tables_are_replaced_as_a_whole(spark):
    path = tempfile.mkdtemp(prefix="funnelkit-table-") + "/t"
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    write_table(spark.range(5), path)
    before, first = read_table(spark, path), current_version(spark, path)
    # a write that dies half-way leaves the old table
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        write_table(broken, path)
    assert current_version(spark, path) == first and read_table(spark, path).count() == 5
    # a table may be made from itself, and a reader keeps the version it has
    write_table(read_table(spark, path).unionByName(spark.range(10, 12)), path)
    assert read_table(spark, path).count() == 7 and before.count() == 5
    for k in range(3):
        write_table(spark.range(k), path)
    assert read_table(spark, path).count() == 2
    assert len([d for d in os.listdir(path) if d.startswith("_v-")]) <= 3
