"""Metric rules over the event table, with windows scaled to its density."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators import rules as R
from waylark.plans import domain as D
from waylark.plans import nested_plans as NP
from waylark.plans.domain import views
from waylark.plans.registry import query
from waylark.session import new_shared_path, pinned
from waylark.sources import writers
from waylark.streaming import alerts, ingest, timed

HOUR = 3600
BOUNDS = [0.1, 0.25, 0.5, 1.0, 2.5]

_WIN = f"""WITH {views("requests")}, spread AS (
  SELECT r.*, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS window_start FROM requests r, range(6) t(k))"""


@query("error_ratio_sliding", _WIN + """
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) FILTER (is_5xx) AS n_errors, count(*) AS n_requests,
       round(count(*) FILTER (is_5xx) / count(*), 9) AS error_ratio FROM spread GROUP BY 1""")
def error_ratio_sliding(spark, sf):
    r = R.error_ratio(D.requests(spark, sf), "ts", F.col("is_5xx"), 6 * HOUR, HOUR)
    return r.withColumn("error_ratio", F.round("error_ratio", 9))


_LE = ", ".join(f"count(*) FILTER (latency_s <= {b}::DOUBLE)::DOUBLE AS le{i}" for i, b in enumerate(BOUNDS))


def _quantile_sql(q):
    arms = []
    for i, b in enumerate(BOUNDS):
        lo = BOUNDS[i - 1] if i else 0.0
        before = f"le{i - 1}" if i else "0"
        arms.append(f"WHEN le{i} >= {q} * n AND le{i} > {before} THEN {lo}::DOUBLE + {b - lo}::DOUBLE * ({q} * n - {before}) / (le{i} - {before})")
    return "CASE " + " ".join(arms) + f" ELSE {BOUNDS[-1]}::DOUBLE END"


@query("latency_p95_histogram", _WIN + f""", h AS (SELECT endpoint, window_start, {_LE}, count(*) AS n FROM spread GROUP BY ALL)
SELECT endpoint, window_start, n AS n_requests, round({_quantile_sql("0.95::DOUBLE")}, 9) AS quantile FROM h""")
def latency_p95_histogram(spark, sf):
    q = R.latency_quantile(D.requests(spark, sf), "ts", "latency_s", BOUNDS, 0.95, 6 * HOUR, HOUR, ["endpoint"])
    return q.select("endpoint", "window_start", "n_requests", F.round("quantile", 9).alias("quantile"))


@query("histogram_quantile", f"""
WITH {views("requests")}, h AS (SELECT endpoint, {_LE}, count(*) AS n FROM requests GROUP BY 1)
SELECT endpoint, round({_quantile_sql("0.5::DOUBLE")}, 9) AS quantile FROM h""")
def histogram_quantile(spark, sf):
    """The same from rows of labelled buckets, as a metric store would hand them over."""
    le = F.array(*[F.lit(b) for b in BOUNDS], F.lit(float("inf")))
    rows = D.requests(spark, sf).select("endpoint", F.explode(le).alias("le"), "latency_s")
    counts = rows.groupBy("endpoint", "le").agg(
        F.sum(F.when(F.col("latency_s") <= F.col("le"), 1).otherwise(0)).alias("n"))
    return R.histogram_quantile(counts, ["endpoint"], "le", "n", 0.5).withColumn("quantile", F.round("quantile", 9))


_HOLD = """, on_ AS (SELECT *, {breach} AS on_now FROM {src}),
p AS (SELECT *, coalesce(lag(on_now) OVER w, FALSE) AS on_before FROM on_ WINDOW w AS (PARTITION BY {series} ORDER BY ts, event_id)),
s AS (SELECT *, max(CASE WHEN on_now AND NOT on_before THEN ts END) OVER (PARTITION BY {series} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS started_at FROM p)
SELECT {series}, started_at, min(ts) FILTER (on_now AND epoch_us(ts) - epoch_us(started_at) >= {hold} * 1000000::BIGINT) AS fired_at,
       max(ts) FILTER (on_now) AS last_breach_at, min(ts) FILTER (NOT on_now) AS resolved_at
FROM s WHERE started_at IS NOT NULL GROUP BY ALL HAVING fired_at IS NOT NULL"""


@query("threshold_hold", f"WITH {views('gauges')}" + _HOLD.format(breach="value > 40", src="gauges", series="name", hold=HOUR))
def threshold_hold(spark, sf):
    return R.threshold_rule(D.gauges(spark, sf), ["name"], "ts", F.col("value") > 40, HOUR, ["event_id"])


# Windows of five minutes every minute, as the rules define them, per service.
_MINUTES = """WITH r AS (SELECT event_id, ts, (user_id % 3)::INT AS service, event_type = 'error' AS is_5xx, value / 100 AS latency_s FROM events),
spread AS (SELECT r.*, date_trunc('minute', ts) + (5 - k) * INTERVAL 1 MINUTE AS window_end FROM r, range(5) t(k))"""


def services(spark, sf):
    return D.table(spark, sf, "events").select(
        "event_id", "ts", (F.col("user_id") % 3).cast("int").alias("service"),
        (F.col("event_type") == "error").alias("is_5xx"), (F.col("value") / 100).alias("latency_s"),
        # Every sixth hour a service needs half a gigabyte more, so the rule has something to find.
        (F.col("value") * 1_500_000 + F.when(F.hour("ts") % 6 == 0, 500_000_000.0).otherwise(0.0)).alias("bytes"))


@query("error_ratio_alerts", _MINUTES + """, levels AS (
  SELECT service, window_end AS ts, 0 AS event_id, count(*) FILTER (is_5xx) / count(*) AS level FROM spread GROUP BY ALL)""" +
  _HOLD.format(breach=f"level > {R.ERROR_RATIO_LIMIT}", src="levels", series="service", hold=R.HOLD_SECONDS))
def error_ratio_alerts(spark, sf):
    """More than 5 % of the requests of five minutes failed, for five minutes."""
    return R.error_ratio_alert(services(spark, sf), "ts", F.col("is_5xx"), ["service"])


def _as_stream(rows, far: str):
    """The rows as a stream that ends with one of a service or name -1 far later, so that every window closes."""
    folder = new_shared_path(rows.sparkSession, "stream")
    last = rows.select(*[
        F.lit(far).cast(rows.schema[c].dataType).alias(c) if c == "ts" else F.lit(-1).alias(c) if c in ("service", "name")
        else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).limit(1)
    both = rows.unionByName(last).withColumn("ts", F.col("ts").cast("timestamp"))
    both.write.parquet(folder)
    return rows.sparkSession.readStream.schema(both.schema).parquet(folder)


def _told(live):
    """All rows of a stream that is read to its end, as a table."""
    spark = live.sparkSession
    out = new_shared_path(spark, "told")
    live.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", new_shared_path(spark, "told-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.schema).parquet(out)


@query("error_ratio_alerts_stream", _MINUTES + """, levels AS (
  SELECT service, window_end AS ts, 0 AS event_id, count(*) FILTER (is_5xx) / count(*) AS level FROM spread GROUP BY ALL),
told AS (""" + _HOLD.format(breach=f"level > {R.ERROR_RATIO_LIMIT}", src="levels", series="service", hold=R.HOLD_SECONDS).replace(", on_ AS", "WITH on_ AS", 1) +
  """) SELECT service, started_at, fired_at, CASE WHEN resolved_at IS NOT NULL THEN last_breach_at END AS last_breach_at, resolved_at FROM told""")
def error_ratio_alerts_stream(spark, sf):
    """`error_ratio_alerts` by one streaming query with state behind its windows."""
    s = _as_stream(services(spark, sf).select("ts", "service", "is_5xx"), "2100-01-01 00:00:00")
    told = _told(timed.error_ratio_alert_stream(s, "ts", F.col("is_5xx"), ["service"]))
    found = timed.latest_episodes(told.where("service >= 0"), ["service"])
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select(
        "service", stamp("started_at"), stamp("fired_at"),
        F.when(F.col("resolved_at").isNotNull(), F.col("last_breach_at")).cast("timestamp_ntz").alias("last_breach_at"), stamp("resolved_at"))


@query("latency_alerts", _MINUTES + f""", h AS (SELECT service, window_end, {_LE}, count(*) AS n FROM spread GROUP BY ALL),
levels AS (SELECT service, window_end AS ts, 0 AS event_id, {_quantile_sql("0.95::DOUBLE")} AS level FROM h)""" +
  _HOLD.format(breach=f"level > {R.LATENCY_LIMIT_SECONDS}", src="levels", series="service", hold=R.HOLD_SECONDS))
def latency_alerts(spark, sf):
    """The 95th percentile of five minutes was above a second, for five minutes."""
    return R.latency_alert(services(spark, sf), "ts", "latency_s", BOUNDS, ["service"])


@query("memory_alerts", _MINUTES + ", sizes AS (SELECT (user_id % 3)::INT AS service, ts, event_id, value * 1500000 + CASE WHEN hour(ts) % 6 = 0 THEN 500000000::DOUBLE ELSE 0::DOUBLE END AS bytes FROM events)" +
  _HOLD.format(breach=f"bytes > {R.MEMORY_LIMIT_BYTES}", src="sizes", series="service", hold=R.MEMORY_HOLD_SECONDS))
def memory_alerts(spark, sf):
    """More than 500 MB for ten minutes."""
    return R.memory_alert(services(spark, sf), ["service"], "ts", "bytes", tie=["event_id"])


@query("last_seen_silence", f"""
WITH {views("gauges")}, n AS (SELECT TIMESTAMP '2024-01-30 22:00:00' AS now)
SELECT name, last_seen, round((epoch_us(now) - epoch_us(last_seen)) / 1000000.0, 6) AS silent_seconds,
       epoch_us(now) - epoch_us(last_seen) > 3600000000 AS is_silent, epoch_us(now) - epoch_us(last_seen) > 7200000000 AS is_firing
FROM (SELECT name, max(ts) AS last_seen FROM gauges WHERE ts <= TIMESTAMP '2024-01-30 22:00:00' GROUP BY 1), n""")
def last_seen_silence(spark, sf):
    now = S.local_ts("2024-01-30 22:00:00")
    g = D.gauges(spark, sf).filter(F.col("ts") <= now)
    return R.last_seen_rule(g, ["name"], "ts", now, HOUR, HOUR).withColumn(
        "silent_seconds", F.round("silent_seconds", 6))


_PAIRS = f"""WITH {views("gauges")}, p AS (
  SELECT name, ts, value, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM gauges WINDOW w AS (PARTITION BY name ORDER BY ts, event_id)),
spread AS (SELECT p.*, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS window_start FROM p, range(6) t(k) WHERE pt IS NOT NULL)"""


_CHANGES = _PAIRS + """
SELECT name, window_start, window_start + INTERVAL 6 HOUR AS window_end,
       sum(CASE WHEN floor(value / 50) <> floor(pv / 50) THEN 1 ELSE 0 END)::BIGINT AS n_changes,
       sum(CASE WHEN floor(value / 50) <> floor(pv / 50) THEN 1 ELSE 0 END) > 3 AS is_firing
FROM spread WHERE pt >= window_start GROUP BY ALL"""

_RATES = _PAIRS + """
SELECT name, window_start, round(sum(CASE WHEN value >= pv THEN value - pv ELSE value END), 4) AS increase,
       round(sum(CASE WHEN value >= pv THEN value - pv ELSE value END) / 21600.0::DOUBLE, 8) AS rate
FROM spread WHERE pt >= window_start GROUP BY ALL"""


@query("changes_in_window", _CHANGES)
def changes_in_window(spark, sf):
    g = D.gauges(spark, sf).withColumn("value", F.floor(F.col("value") / 50))
    return R.changes_rule(g, ["name"], ["ts", "event_id"], "value", 6 * HOUR, HOUR)


@query("counter_rate", _RATES)
def counter_rate(spark, sf):
    c = R.counter_rate(D.gauges(spark, sf), ["name"], ["ts", "event_id"], "value", 6 * HOUR, HOUR)
    return c.select("name", "window_start", F.round("increase", 4).alias("increase"), F.round("rate", 8).alias("rate"))


def _stamps(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("changes_in_window_stream", _CHANGES)
def changes_in_window_stream(spark, sf):
    """`changes_in_window` by one streaming query that orders the samples itself."""
    g = _as_stream(D.gauges(spark, sf).withColumn("value", F.floor(F.col("value") / 50)), "2100-01-01 00:00:00")
    w = _told(timed.changes_stream(g, ["name"], "ts", "value", 6 * HOUR, HOUR, tie="event_id"))
    return _stamps(w, "window_start", "window_end")


@query("counter_rate_stream", _RATES)
def counter_rate_stream(spark, sf):
    """`counter_rate` by one streaming query that orders the samples itself."""
    g = _as_stream(D.gauges(spark, sf), "2100-01-01 00:00:00")
    w = _told(timed.counter_rate_stream(g, ["name"], "ts", "value", 6 * HOUR, HOUR, tie="event_id"))
    return _stamps(w, "window_start").select(
        "name", "window_start", F.round("increase", 4).alias("increase"), F.round("rate", 8).alias("rate"))


@query("endpoint_stats", f"""
WITH {views("requests")}
SELECT endpoint, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n_requests,
       round(count(*) / 21600.0::DOUBLE, 9) AS requests_per_second, quantile_disc(latency_s, 0.5) AS p50,
       quantile_disc(latency_s, 0.95) AS p95, quantile_disc(latency_s, 0.99) AS p99, round(avg(size), 6) AS mean_size
FROM requests GROUP BY ALL""")
def endpoint_stats(spark, sf):
    s = R.endpoint_stats(D.requests(spark, sf), "ts", "endpoint", "latency_s", "size", 6 * HOUR)
    return s.withColumns({"requests_per_second": F.round("requests_per_second", 9), "mean_size": F.round("mean_size", 6)})


_ROLLUP = f"""
WITH {views("requests")}, spread AS (SELECT r.*, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 2 HOUR AS window_start
                                     FROM requests r, range(3) t(k))
SELECT endpoint, window_start, count(*) AS n_requests, round(count(*) / 21600.0::DOUBLE, 9) AS requests_per_second,
       quantile_disc(latency_s, 0.5) AS p50, quantile_disc(latency_s, 0.95) AS p95, quantile_disc(latency_s, 0.99) AS p99,
       round(avg(size), 6) AS mean_size
FROM spread GROUP BY ALL"""


def _rolled(panes):
    s = R.endpoint_rollup(panes, HOUR, 6 * HOUR, 2 * HOUR)
    return s.withColumns({"requests_per_second": F.round("requests_per_second", 9), "mean_size": F.round("mean_size", 6)})


@query("endpoint_rollup", _ROLLUP)
def endpoint_rollup(spark, sf):
    """Sliding windows of six hours merged from stored sketches of an hour."""
    return _rolled(pinned(R.endpoint_panes(D.requests(spark, sf), "ts", "endpoint", "latency_s", "size", HOUR), "panes"))


@query("endpoint_rollup_stream", _ROLLUP)
def endpoint_rollup_stream(spark, sf):
    """The same from panes that a stream has appended."""
    s = _as_stream(D.requests(spark, sf), "2100-01-01 00:00:00")
    panes = _told(alerts.endpoint_panes_stream(s, "ts", "endpoint", "latency_s", "size", HOUR))
    return _rolled(panes.where(F.col("endpoint").isNotNull()))


@query("alert_grouping", """
WITH a AS (SELECT (user_id % 3)::INT AS name, (event_id % 2)::INT AS service, event_id, ts AS fired_at,
           ts + floor(value)::INT * INTERVAL 1 MINUTE AS resolved_at FROM events),
e1 AS (SELECT *, max(resolved_at) OVER (PARTITION BY name, service ORDER BY fired_at, event_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_until FROM a),
e2 AS (SELECT *, max(CASE WHEN open_until IS NULL OR fired_at > open_until THEN fired_at END)
              OVER (PARTITION BY name, service ORDER BY fired_at, event_id ROWS UNBOUNDED PRECEDING) AS episode_start FROM e1),
news AS (SELECT name, service, episode_start,
                greatest(0, ceil(((epoch_us(fired_at) - epoch_us(episode_start)) / 1000000.0 - 30) / 300.0))::BIGINT AS tick,
                count(*) AS n_alerts, max(resolved_at) AS fin FROM e2 GROUP BY ALL),
closing AS (SELECT name, service, episode_start,
                   greatest(1, ceil(((epoch_us(max(fin)) - epoch_us(episode_start)) / 1000000.0 - 30) / 300.0))::BIGINT AS tick,
                   'resolved' AS kind, 0::BIGINT AS n_alerts FROM news GROUP BY name, service, episode_start),
told AS (SELECT name, service, episode_start, tick, 'firing' AS kind, n_alerts FROM news UNION ALL
         SELECT name, service, episode_start, tick, kind, n_alerts FROM closing),
gaps AS (SELECT *, lag(tick) OVER (PARTITION BY name, service, episode_start ORDER BY tick, kind) AS before FROM told),
repeats AS (SELECT name, service, episode_start, before + unnest(range(1, (tick - before - 1) // 48 + 1)) * 48 AS tick,
                   'repeat' AS kind, 0::BIGINT AS n_alerts FROM gaps WHERE tick - before - 1 >= 48)
SELECT name, service, episode_start, episode_start + (30 + tick * 300)::INT * INTERVAL 1 SECOND AS notified_at, kind, n_alerts
FROM (SELECT * FROM told UNION ALL SELECT * FROM repeats)""")
def alert_grouping(spark, sf):
    a = D.table(spark, sf, "events").select(
        (F.col("user_id") % 3).cast("int").alias("name"), (F.col("event_id") % 2).cast("int").alias("service"),
        "event_id", F.col("ts").alias("fired_at"),
        F.timestamp_add("MINUTE", F.floor("value").cast("int"), F.col("ts")).alias("resolved_at"))
    return R.group_alerts(a, ["name", "service"], tie=["event_id"])


@query("alert_routes", """
SELECT CASE event_type WHEN 'error' THEN 'critical-with-remediation' ELSE 'email-default' END AS route, count(*) AS n
FROM events GROUP BY 1""")
def alert_routes(spark, sf):
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "warning")
    return D.table(spark, sf, "events").groupBy(R.route_of(severity).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("ingest_stream_batch_equal", NP._FLAT + """
SELECT flight_sk, journey_sk, departure_airport_time, price, is_best, pos, is_delayed FROM flat
QUALIFY row_number() OVER (PARTITION BY flight_sk ORDER BY is_best DESC, price) = 1""")
def ingest_stream_batch_equal(spark, sf):
    """Documents written as files, streamed into the fact table, and the table read back."""
    base = new_shared_path(spark, "ingest")
    # JSON is mostly names of fields, so packed it takes a tenth.
    writers.write_documents(NP.D.responses(spark, sf).select("json_data"), f"{base}/documents", 50_000, "gzip")
    q = ingest.ingest_stream(spark, f"{base}/documents", f"{base}/fact", f"{base}/checkpoint",
                             now=S.local_ts("2024-02-01"), wholetext=False, partition="journey_month")
    q.awaitTermination()
    fact = spark.read.schema(ingest.schemas.SEGMENT).parquet(f"{base}/fact")
    return fact.select("flight_sk", "journey_sk", "departure_airport_time",
                       F.col("price").cast("double").alias("price"), "is_best", "pos", "is_delayed")
