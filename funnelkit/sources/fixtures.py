"""Derive the four raw funnel tables from the driver's TPC-H-like test tables.

The test tables hold no funnel, so the rules of FIXTURES.md section B turn
them into one: ``orders`` become experts, ``lineitem`` rows become milestone
events and engagements, ``events`` becomes daily channel spend.  Integer and
two-decimal arithmetic only, so that an independent SQL engine gets the same
rows.  The text is deliberately unclean (case, blanks) so staging has work, and
the rows hold what the data-quality tests look for: events of unknown experts,
unknown event names, repeated event ids, missing payouts, channels and days.
Every row of the test tables is used; none is left out.

Plan notes (scale): experts join orders to customer on the customer key
(shuffled, AQE may turn it into a broadcast at runtime) and to nation
(TPC-H fixes it at 25 rows, so it is broadcast explicitly).  Events and
engagements need no join: the signup time is a function of the order key.
The per-order line sequence is one window partitioned by ``l_orderkey``
(at most 7 lines per TPC-H order, so no hot partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import add_hours, ntz
from ..operators.slices import spread, task_parts
from .raw import RawTables
from .schemas import raw_schemas

# --- fixed values of the derivation -----------------------------------------
SIGNUP_EPOCH = "2024-01-01 00:00:00"
SIGNUP_STEP = 7919  # hours multiplier
SIGNUP_SPAN = 8784  # hours in 2024
ORPHAN_MOD = 101  # rows of orders with key % 101 = 0 belong to expert -key, who has no profile
UNKNOWN_EVENT_MOD = 97  # the signup of orders with key % 97 = 0 has an unknown name
UNKNOWN_EVENT = "account_created"
NO_UTM_MOD = 23
PRIORITY_SOURCE = [
    ("1", " Paid_Search "),
    ("2", "paid_social"),
    ("3", "LinkedIn_Outreach"),
    ("4", "organic"),
]
PRIORITY_CAMPAIGN_PREFIX = [("1", "Paid_Search"), ("2", "Paid_Social"), ("3", "LinkedIn_Outreach")]
# l_linenumber -> (event_name, hours after signup = a + b * quantity)
LINE_EVENTS = [
    (1, "profile_started", 0, 1),
    (2, "profile_completed", 12, 2),
    (3, "verification_submitted", 40, 1),
    (4, "verification_approved", 60, 2),
    (5, "verification_approved", 60, 2),  # rejected instead when l_partkey % 6 = 0
    (6, "first_engagement_completed", 72, 48),
    (7, "profile_started", -3, 1),
]
SPEND_CHANNEL = [("click", "Paid_Search"), ("view", "Paid_Social"), ("purchase", "LinkedIn_Outreach"), ("signup", "Referral_Fee")]
NO_CHANNEL = "Unattributed"  # campaign prefix of the other event types, whose channel is NULL


def _signup_ts(order_key: Column) -> Column:
    return add_hours(ntz(SIGNUP_EPOCH), (order_key * SIGNUP_STEP) % SIGNUP_SPAN)


def _expert(order_key: Column) -> Column:
    return F.when(order_key % ORPHAN_MOD == 0, -order_key).otherwise(order_key)


def _case(key: Column, pairs, default=None) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(default if default is not None else F.lit(None))


def experts(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = nation.select("n_nationkey", "n_name")
    prio = F.substring("o_orderpriority", 1, 1)
    key = F.col("o_orderkey")
    source = _case(
        prio,
        PRIORITY_SOURCE,
        F.when(prio == F.lit("5"), F.when(key % 2 == 0, F.lit("referral")).otherwise(F.lit("unknown"))),
    )
    camp_no = F.when(F.col("o_custkey") % 40 == 7, F.lit(5)).otherwise(F.col("o_custkey") % 5)
    prefix = _case(prio, PRIORITY_CAMPAIGN_PREFIX)
    campaign = F.when(
        prefix.isNotNull() & (key % NO_UTM_MOD != 0),
        F.concat(prefix, F.lit("_Camp_"), camp_no.cast("string")),
    )
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
    return joined.select(
        key.alias("expert_id"),
        _signup_ts(key).alias("signup_date"),
        source.alias("signup_source"),
        campaign.alias("utm_campaign"),
        F.when(campaign.isNotNull(), F.lit("CPC")).alias("utm_medium"),
        F.when(campaign.isNotNull(), F.lit("Ads")).alias("utm_source"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("industry"),
    )


def _lines_with_seq(lineitem: DataFrame) -> DataFrame:
    """lineitem rows with their per-order sequence.  Orders are dealt over more
    tasks the more lines there are, so a task sorts no more of a larger table."""
    lineitem = spread(lineitem, task_parts(lineitem.sparkSession, lineitem.count()), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"
    )
    return lineitem.withColumn("seq", F.row_number().over(order)).withColumn("q", F.col("l_quantity").cast("int"))


def funnel_events(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    signups = orders.select(
        (key * 1000).alias("event_id"),
        _expert(key).alias("expert_id"),
        F.when(key % UNKNOWN_EVENT_MOD == 0, F.lit(UNKNOWN_EVENT)).otherwise(F.lit("signup")).alias("event_name"),
        _signup_ts(F.col("o_orderkey")).alias("event_timestamp"),
        F.lit(None).cast("string").alias("event_properties"),
    )
    lines = _lines_with_seq(lineitem)
    ln, q = F.col("l_linenumber"), F.col("q")
    rejected = (ln == 5) & (F.col("l_partkey") % 6 == 0)
    name = F.when(rejected, F.lit("verification_rejected")).otherwise(
        _case(ln, [(n, e) for n, e, _, _ in LINE_EVENTS])
    )
    offset = None
    for n, _, a, b in LINE_EVENTS:
        h = F.lit(a) + F.lit(b) * q
        offset = F.when(ln == n, h) if offset is None else offset.when(ln == n, h)
    dirty = F.col("l_suppkey") % 10 == 0
    # some third lines repeat the id of their order's signup
    repeated = (ln == 3) & (F.col("l_partkey") % 50 == 0)
    line_events = lines.select(
        (F.col("l_orderkey") * 1000 + F.when(repeated, F.lit(0)).otherwise(F.col("seq"))).alias("event_id"),
        _expert(F.col("l_orderkey")).alias("expert_id"),
        F.when(dirty, F.concat(F.upper(name), F.lit(" "))).otherwise(name).alias("event_name"),
        add_hours(_signup_ts(F.col("l_orderkey")), offset).alias("event_timestamp"),
        F.when(rejected, F.concat(F.lit('{"k": '), (F.col("l_partkey") % 100).cast("string"), F.lit("}"))).alias(
            "event_properties"
        ),
    )
    return signups.unionByName(line_events)


def engagements(lineitem: DataFrame) -> DataFrame:
    lines = _lines_with_seq(lineitem).where((F.col("l_linenumber") >= 6) | (F.col("l_returnflag") == "R"))
    q = F.col("q")
    return lines.select(
        (F.col("l_orderkey") * 1000 + F.col("seq")).alias("engagement_id"),
        _expert(F.col("l_orderkey")).alias("expert_id"),
        F.when(F.col("l_linestatus") == "O", F.lit("survey")).otherwise(F.lit("Interview ")).alias("engagement_type"),
        add_hours(_signup_ts(F.col("l_orderkey")), F.lit(72) + F.lit(48) * q).alias("engagement_date"),
        F.when(F.col("l_partkey") % 500 == 250, F.lit(None))
        .when(F.col("l_partkey") % 250 == 0, F.lit(0))
        .otherwise(q * 5)
        .cast("decimal(18,2)")
        .alias("payout_amount"),
        F.concat(F.lit("ind_"), (F.col("l_suppkey") % 8).cast("string")).alias("client_industry"),
    )


def daily_channel_spend(events: DataFrame) -> DataFrame:
    channel = _case(F.col("event_type"), SPEND_CHANNEL)
    # some days of a campaign are booked a day late, which leaves gaps
    late = (F.dayofmonth("ts") * 7 + F.col("user_id") % 5) % 11 == 0
    kept = events.select(
        F.date_add(F.to_date("ts"), F.when(late, 1).otherwise(0)).alias("date"),
        channel.alias("channel"),
        F.concat(F.coalesce(channel, F.lit(NO_CHANNEL)), F.lit("_Camp_"), (F.col("user_id") % 5).cast("string")).alias("campaign_name"),
        F.col("value").cast("decimal(18,2)").alias("value"),
    )
    return kept.groupBy("date", "channel", "campaign_name").agg(
        F.sum("value").cast("decimal(18,2)").alias("spend_usd"),
        (F.count(F.lit(1)) * 100).alias("impressions"),
        F.count(F.lit(1)).alias("clicks"),
    )


def read_testdata(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def fixture_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """The four raw funnel tables derived from ``{sf_dir}/*.parquet``.

    Each test table is read on first use and each raw table is planned on
    first use, so a report touching only experts reads only their sources.
    """
    reads: dict[str, DataFrame] = {}

    def t(name: str) -> DataFrame:
        if name not in reads:
            reads[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return reads[name]

    builders = {
        "experts": lambda: experts(t("orders"), t("customer"), t("nation")),
        "funnel_events": lambda: funnel_events(t("orders"), t("lineitem")),
        "engagements": lambda: engagements(t("lineitem")),
        "daily_channel_spend": lambda: daily_channel_spend(t("events")),
    }
    return RawTables(loader=lambda name: builders[name]())


def load_fixture(spark: SparkSession, sf_dir: str, base: str | None = None) -> RawTables:
    """Derive the raw tables, each once and on first use, store them as parquet
    and return readers: a report derives the tables that it reads.

    ``base`` defaults to a fresh folder under the session's
    ``spark.checkpoint.dir`` (shared storage on a cluster).
    """
    import uuid

    from ..session import run_folder

    base = base or f"{run_folder(spark)}/raw-{uuid.uuid4().hex[:12]}"
    derived, schemas = fixture_tables(spark, sf_dir), raw_schemas()

    def load(name: str) -> DataFrame:
        derived.table(name).write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(schemas[name]).parquet(f"{base}/{name}")

    return RawTables(loader=load)
