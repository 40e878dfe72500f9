"""Queries over activity events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import scores, text
from sparkloom.operators import relational
from sparkloom.registry import query
from sparkloom.sources.tables import filtered, table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT event_id) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_aggregate_type_day(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return _events(spark, sf).groupBy("event_type", day).agg(F.countDistinct("event_id").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT date_trunc('day', ts)::DATE AS bucket, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def events_timeline_day(spark, sf):
    return _events(spark, sf).groupBy(F.to_date("ts").alias("bucket")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 20")
def events_filtered_page(spark, sf):
    rows = filtered(_events(spark, sf), {"event_type": "click"}, between=("ts", F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-20"))))
    return rows.select("event_id", "ts", "user_id", "event_type").orderBy(F.desc("ts"), "event_id").offset(20).limit(100)


@query("SELECT event_id, user_id, event_type, props FROM events WHERE contains(lower(props), '\"k\": 7') AND event_type <> 'view' AND strftime(ts, '%Y-%m') LIKE '2024-01%'")
def events_exact_query(spark, sf):
    rows = filtered(_events(spark, sf), keyword=('"k": 7', ["props"])).where(F.date_format("ts", "yyyy-MM").startswith("2024-01") & (F.col("event_type") != "view"))
    return rows.select("event_id", "user_id", "event_type", "props")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids, count(*) - count(DISTINCT event_id) AS repeats, count(*) FILTER (user_id IS NULL) AS no_user, count(*) FILTER (value IS NULL OR value < 0) AS bad_value, count(*) FILTER (coalesce(trim(props), '') = '') AS blank_props, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def events_quality_report(spark, sf):
    return _events(spark, sf).agg(
        F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), (F.count("*") - F.countDistinct("event_id")).alias("repeats"),
        F.count_if(F.col("user_id").isNull()).alias("no_user"), F.count_if(F.col("value").isNull() | (F.col("value") < 0)).alias("bad_value"),
        F.count_if(F.trim(F.coalesce("props", F.lit(""))) == "").alias("blank_props"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query("""SELECT user_id, recent, prior, CASE WHEN prior > 0 AND recent = 0 THEN 'abandoned' WHEN recent >= 2 * greatest(prior, 1) THEN 'surging' WHEN prior > recent THEN 'declining' WHEN recent >= 3 THEN 'continuous' ELSE 'occasional' END AS trend, peak_week
FROM (SELECT user_id, sum(n) FILTER (w >= DATE '2024-01-15')::BIGINT AS r, coalesce(sum(n) FILTER (w >= DATE '2024-01-15'), 0)::BIGINT AS recent, coalesce(sum(n) FILTER (w < DATE '2024-01-15'), 0)::BIGINT AS prior, arg_max(w, struct_pack(n := n, w := w)) AS peak_week
  FROM (SELECT user_id, date_trunc('week', ts)::DATE AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)""")
def events_user_trend(spark, sf):
    weekly = _events(spark, sf).groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("w")).agg(F.count("*").alias("n"))
    late = F.col("w") >= F.lit("2024-01-15").cast("date")
    users = weekly.groupBy("user_id").agg(F.sum(F.when(late, F.col("n")).otherwise(0)).alias("recent"),
        F.sum(F.when(~late, F.col("n")).otherwise(0)).alias("prior"), F.max_by("w", F.struct("n", "w")).alias("peak_week"))
    trend = (
        F.when((F.col("prior") > 0) & (F.col("recent") == 0), "abandoned")
        .when(F.col("recent") >= 2 * F.greatest("prior", F.lit(1)), "surging")
        .when(F.col("prior") > F.col("recent"), "declining")
        .when(F.col("recent") >= 3, "continuous")
        .otherwise("occasional")
    )
    return users.select("user_id", "recent", "prior", trend.alias("trend"), "peak_week")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, list_sort(min(event_id, 3)) AS examples FROM events GROUP BY event_type")
def events_category_examples(spark, sf):
    rows = _events(spark, sf)
    firsts = relational.top_per_group(rows.select("event_type", "event_id"), "event_type", 3, F.col("event_id")).groupBy("event_type").agg(F.array_sort(F.collect_list("event_id")).alias("examples"))
    counts = rows.groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(firsts, "event_type").join(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "examples")


@query("""SELECT dimension, label, n FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, label) AS rk FROM (
  SELECT 'type' AS dimension, event_type AS label, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user', user_id::VARCHAR, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'hour', strftime(ts, '%H'), count(*) FROM events GROUP BY 2)) WHERE rk <= 12""")
def events_focus_ranking(spark, sf):
    dims = _events(spark, sf).select(F.explode(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("hour"),
        F.date_format("ts", "HH"))).alias("dimension", "label"))
    counts = dims.groupBy("dimension", "label").agg(F.count("*").alias("n"))
    return relational.top_per_group(counts, "dimension", 12, F.desc("n"), F.col("label")).drop("rank")


@query("""SELECT event_id, user_id, event_type, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR ts - prev >= INTERVAL 24 HOUR""")
def events_cooldown(spark, sf):
    """Events that come a day or more after the last of their key."""
    prev = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = _events(spark, sf).withColumn("prev", prev)
    return rows.where(F.col("prev").isNull() | (F.col("ts") >= F.col("prev") + F.expr("INTERVAL 24 HOURS"))).select("event_id", "user_id", "event_type", "ts")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
SELECT user_id, no::BIGINT AS session_no, count(*) AS n, min(ts) AS started, max(ts) AS ended, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id, no""")
def events_sessions(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") <= F.lag("ts").over(order) + F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    rows = _events(spark, sf).withColumn("fresh", fresh).withColumn("session_no", F.sum("fresh").over(order))
    return rows.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.countDistinct("event_type").alias("kinds"))


@query("""WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS hits FROM events GROUP BY user_id)
SELECT user_id, n, hits, CASE WHEN n < 5 THEN NULL ELSE round(((hits / n + 3.8416 / (2 * n)) - 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) END AS low,
CASE WHEN n < 5 THEN NULL ELSE round(((hits / n + 3.8416 / (2 * n)) + 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) END AS high FROM c""")
def events_wilson_purchase(spark, sf):
    """Share of purchases with its interval; none for users with under five events."""
    rows = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("hits"))
    low, high = scores.wilson(F.col("hits"), F.col("n"))
    return rows.select("user_id", "n", "hits", *[F.when(F.col("n") >= 5, F.round(x, 6)).alias(name) for x, name in ((low, "low"), (high, "high"))])


@query("""SELECT p.event_id, p.user_id, p.ts, c.event_id AS asof_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT event_id FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) c ON true""")
def events_purchase_asof_click(spark, sf):
    rows = _events(spark, sf)
    purchases = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = rows.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return relational.as_of(purchases, clicks, ["user_id"], "ts", ["click"])


@query("""WITH m AS (SELECT max(ts) AS now FROM events), a AS (SELECT user_id, date_diff('second', max(ts), any_value(now)) / 3600.0 AS age FROM events, m GROUP BY user_id)
SELECT user_id, round(age, 4) AS age, round(CASE WHEN age <= 24 THEN 1 ELSE pow(0.5, (age - 24) / 168) END, 6) AS freshness FROM a""")
def events_freshness(spark, sf):
    rows = _events(spark, sf)
    latest = rows.agg(F.max("ts").alias("now"))
    ages = rows.groupBy("user_id").agg(F.max("ts").alias("last")).join(F.broadcast(latest)).withColumn("age", (F.unix_timestamp("now") - F.unix_timestamp("last")) / 3600.0)
    return ages.select("user_id", F.round("age", 4).alias("age"), F.round(scores.freshness(F.col("age"), 24, 168), 6).alias("freshness"))


@query("SELECT event_type, count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 7) AS quiet, count(*) FILTER (hour(ts) < 22 AND hour(ts) >= 7) AS awake FROM events GROUP BY event_type")
def events_quiet_hours(spark, sf):
    q = scores.quiet(F.col("ts"))
    return _events(spark, sf).groupBy("event_type").agg(F.count_if(q).alias("quiet"), F.count_if(~q).alias("awake"))


@query("SELECT json_extract(props, '$.k')::INTEGER AS k, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_json_props(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return _events(spark, sf).groupBy(k.alias("k"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_id, sha256(event_id::VARCHAR || '|' || user_id::VARCHAR || '|' || event_type) AS record_id, substr(sha1(least(event_id, user_id)::VARCHAR || '|' || greatest(event_id, user_id)::VARCHAR), 1, 16) AS pair_id FROM events")
def events_ids(spark, sf):
    return _events(spark, sf).select("event_id", text.record_id(F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("record_id"),
        text.pair_id(F.col("event_id"), F.col("user_id")).alias("pair_id"))


@query("""WITH j AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, md5(event_id::VARCHAR || event_type) AS sum FROM events),
l AS (SELECT *, lag(sum) OVER (PARTITION BY user_id ORDER BY seq) AS prev, max(seq) OVER (PARTITION BY user_id) AS top FROM j)
SELECT user_id, count(*) AS n, bool_and(seq = 1 OR prev IS NOT NULL) AS linked, max(top) = count(*) AS gapless, md5(string_agg(sum, '' ORDER BY seq)) AS head FROM l GROUP BY user_id""")
def events_chain_verify(spark, sf):
    """Per user: is the log gapless, does each entry follow another, and the digest of the chain."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    log = _events(spark, sf).select("user_id", F.row_number().over(order).alias("seq"), F.md5(F.concat(F.col("event_id").cast("string"), "event_type")).alias("sum"))
    log = log.withColumn("prev", F.lag("sum").over(Window.partitionBy("user_id").orderBy("seq")))
    head = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sum"))), lambda x: x["sum"]), ""))
    return log.groupBy("user_id").agg(F.count("*").alias("n"), F.bool_and((F.col("seq") == 1) | F.col("prev").isNotNull()).alias("linked"),
        (F.max("seq") == F.count("*")).alias("gapless"), head.alias("head"))


@query("""SELECT event_type AS state, prev, count(*) AS n, CASE WHEN prev IS NULL THEN event_type = 'signup' WHEN prev = 'purchase' THEN event_type IN ('view', 'click') WHEN prev = 'error' THEN event_type <> 'purchase' ELSE true END AS legal
FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY ALL""")
def events_transitions(spark, sf):
    """Counts of state transitions against a table of the legal ones."""
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _events(spark, sf).select(F.col("event_type").alias("state"), prev.alias("prev"))
    legal = F.when(F.col("prev").isNull(), F.col("state") == "signup").when(F.col("prev") == "purchase",
        F.col("state").isin("view", "click")).when(F.col("prev") == "error", F.col("state") != "purchase").otherwise(F.lit(True))
    return rows.groupBy("state", "prev").agg(F.count("*").alias("n")).withColumn("legal", legal)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(DISTINCT event_type) OVER (PARTITION BY user_id, ts) AS kinds FROM events WHERE ts <= TIMESTAMP '2024-01-15')
SELECT user_id, event_id, CASE WHEN kinds > 1 THEN 'conflict' ELSE event_type END AS state FROM r WHERE rn = 1""")
def events_state_asof(spark, sf):
    """The latest state of every user as of a time; different states at that instant are a conflict."""
    known = _events(spark, sf).where("ts <= TIMESTAMP '2024-01-15 00:00:00'")
    last = known.groupBy("user_id").agg(F.max("ts").alias("ts"))
    kinds = known.join(last, ["user_id", "ts"]).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.countDistinct("event_type").alias("kinds"),
        F.max_by("event_type", "event_id").alias("event_type"))
    return kinds.select("user_id", "event_id", F.when(F.col("kinds") > 1, "conflict").otherwise(F.col("event_type")).alias("state"))


@query("SELECT user_id, min(value) AS least, arg_min(value, struct_pack(ts := ts, e := event_id)) AS first_value, arg_max(value, struct_pack(ts := ts, e := event_id)) AS last_value, CASE WHEN arg_max(value, struct_pack(ts := ts, e := event_id)) > arg_min(value, struct_pack(ts := ts, e := event_id)) THEN 'increase' WHEN arg_max(value, struct_pack(ts := ts, e := event_id)) < arg_min(value, struct_pack(ts := ts, e := event_id)) THEN 'decrease' ELSE 'maintain' END AS verdict FROM events GROUP BY user_id")
def events_endpoint_trend(spark, sf):
    at = F.struct("ts", "event_id")
    rows = _events(spark, sf).groupBy("user_id").agg(F.min("value").alias("least"), F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))
    return rows.withColumn("verdict", F.when(F.col("last_value") > F.col("first_value"), "increase").when(F.col("last_value") < F.col("first_value"), "decrease").otherwise("maintain"))
