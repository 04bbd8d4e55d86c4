"""Example queries over the driver's tables, each with the SQL that gives the same rows.

Streams: E (all events) and one stream for each event type; cents is value in whole hundredths, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep import control
from rillcep.env import CEPEnvironment, Execution

FIELDS = ("event_id", "user_id", "event_type", "cents", "ms")
KINDS = {"Click": "click", "View": "view", "Purchase": "purchase", "Signup": "signup", "Fault": "error"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms FROM events)"
#: Orders used below: of a user's events, and of all.
U, G = "PARTITION BY user_id ORDER BY us, event_id", "ORDER BY us, event_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), ms.alias("ms"), "ts")


def environment(spark: SparkSession, sf_dir: str) -> CEPEnvironment:
    env, e = CEPEnvironment(spark), events(spark, sf_dir)
    env.register_stream("E", e, *FIELDS, ts="ts", seq="event_id")
    for name, kind in KINDS.items():
        env.register_stream(name, e.where(F.col("event_type") == kind), *FIELDS, ts="ts", seq="event_id")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    env.register_stream("Customers", customers.withColumn("at", F.lit(0).cast("long")), "c_custkey", "c_nationkey", "c_acctbal", ts="at", seq="c_custkey")
    env.register_extension("custom:plus", lambda *c: sum(c[1:], c[0]), "scalar", lambda t: "double" if {"float", "double"} & set(t) else "long")
    env.register_extension("custom:top", lambda c: F.max(c), "aggregator", lambda t: t[0])
    env.register_extension("custom:lastTwo", LastTwo, "window")
    env.register_extension("custom:hourOf", lambda df: df.withColumn("hour", F.floor(F.col("__us") / 3_600_000_000) % 24), "stream")
    return env


class LastTwo:
    """An extension window: the last two events."""

    def __init__(self):
        self.held = []

    def add(self, event):
        self.held = [*self.held[-1:], event]
        return self.held


def add(name: str, cql: str, sql: str | None, out: str = "O", base: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Execution(environment(spark, sf_dir), _parsed(cql)).returns(out)

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = f"{BASE}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}" if base else sql


def _parsed(cql: str):
    from rillcep.lang import parse

    return parse(cql)


# Projection, filter, expressions
add("passthrough", "from E insert into O", "SELECT event_id, user_id, event_type, cents, ms FROM e")
add("project_alias", "from E select event_type, event_id as id, event_id as again insert into O", "SELECT event_type, event_id AS id, event_id AS again FROM e")
add("select_star", "from E[cents > 5000] select * insert into O", "SELECT event_id, user_id, event_type, cents, ms FROM e WHERE cents > 5000")
add("filter_simple", "from E[event_type == 'click' and cents > 2500] select event_id, cents insert into O", "SELECT event_id, cents FROM e WHERE event_type = 'click' AND cents > 2500")
add("filter_bool", "from E[not (event_type == 'view') and (cents <= 100 or cents >= 9000) and user_id != 3] select event_id insert into O", "SELECT event_id FROM e WHERE NOT event_type = 'view' AND (cents <= 100 OR cents >= 9000) AND user_id <> 3")
add("filter_null", "from E[(10 / (user_id % 2)) is null] select event_id insert into O", "SELECT event_id FROM e WHERE user_id % 2 = 0")
add("arith_promote", "from E select event_id, cents + 1 as a, cents * 2.5 as b, cents - 1L as c, -cents as d insert into O", "SELECT event_id, cents + 1 AS a, cents * CAST(2.5 AS DOUBLE) AS b, cents - 1 AS c, -cents AS d FROM e")
add("div_mod", "from E select event_id, (cents - 5000) / 7 as q, (cents - 5000) % 7 as r, cents / user_id as z, cents / 8.0 as f insert into O", "SELECT event_id, (cents - 5000) // 7 AS q, (cents - 5000) % 7 AS r, cents // nullif(user_id, 0) AS z, cents / CAST(8 AS DOUBLE) AS f FROM e")
add("fn_coalesce_default", "from E select event_id, coalesce(cents / (user_id % 3), 0L) as a, default(cents / (user_id % 2), 7L) as b insert into O", "SELECT event_id, coalesce(cents // nullif(user_id % 3, 0), 0) AS a, coalesce(cents // nullif(user_id % 2, 0), 7) AS b FROM e")
add("fn_ifthenelse", "from E select event_id, ifThenElse(cents > 5000, 'high', 'low') as level insert into O", "SELECT event_id, CASE WHEN cents > 5000 THEN 'high' ELSE 'low' END AS level FROM e")
add("fn_minmax", "from E select event_id, maximum(cents, user_id, 500) as hi, minimum(cents, user_id, 500) as lo insert into O", "SELECT event_id, greatest(cents, user_id, 500) AS hi, least(cents, user_id, 500) AS lo FROM e")
add("fn_cast_convert", "from E select event_id, cast(cents, 'string') as s, convert(event_type, 'int') as n, convert(cents, 'double') as d insert into O", "SELECT event_id, CAST(cents AS VARCHAR) AS s, TRY_CAST(event_type AS INTEGER) AS n, CAST(cents AS DOUBLE) AS d FROM e")
add("fn_instanceof", "from E select event_id, instanceOfLong(cents) as a, instanceOfString(cents) as b, instanceOfLong(cents / (user_id % 2)) as c insert into O", "SELECT event_id, true AS a, false AS b, user_id % 2 <> 0 AS c FROM e")
add("fn_instanceof_all", "from E select event_id, instanceOfInteger(1) as a, instanceOfDouble(cents / 2.0) as b, instanceOfFloat(cents) as c, instanceOfBoolean(cents > 5) as d, instanceOfBoolean(event_type) as e insert into O", "SELECT event_id, true AS a, true AS b, false AS c, true AS d, false AS e FROM e")
add("fn_event_timestamp", "from E select event_id, eventTimestamp() as at insert into O", "SELECT event_id, ms AS at FROM e")
add("fn_create_set", "from E select event_id, sizeOfSet(createSet(event_type)) as n insert into O", "SELECT event_id, 1 AS n FROM e")
add("fn_pol2cart", "from E#pol2Cart(90.0, 2.0) select event_id, x < 0.001 as zero, y as y insert into O", "SELECT event_id, true AS zero, CAST(2.0 AS DOUBLE) AS y FROM e")
add("ext_plus", "from E select event_id, custom:plus(event_id, user_id, cents) as total insert into O", "SELECT event_id, event_id + user_id + cents AS total FROM e")
add("ext_aggregator", "partition with (user_id of E) begin from E#window.length(3) select event_id, custom:top(cents) as top insert into O; end", f"SELECT event_id, max(cents) OVER ({U} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS top FROM e")
add("ext_window", "partition with (user_id of E) begin from E#window.custom:lastTwo() select event_id, sum(cents) as total insert into O; end", f"SELECT event_id, CAST(sum(cents) OVER ({U} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM e")
add("ext_stream_fn", "from E#custom:hourOf() select event_id, hour insert into O", "SELECT event_id, (us // 3600000000) % 24 AS hour FROM e")
add("union_insert", "from Click select event_id, cents insert into O; from View select event_id, cents insert into O; from Purchase select event_id, cents insert into O;", "SELECT event_id, cents FROM e WHERE event_type IN ('click', 'view', 'purchase')")
add("chain", "from E[cents > 3000] select event_id, user_id, cents insert into M; from M[cents < 6000] select event_id, cents * 2 as twice insert into O;", "SELECT event_id, cents * 2 AS twice FROM e WHERE cents > 3000 AND cents < 6000")
add("define_stream_output", "define stream O (id long, price double); from E select event_id, cents insert into O", "SELECT event_id AS id, CAST(cents AS DOUBLE) AS price FROM e")

# Running aggregation
RUN = f"OVER ({U} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add("running_group_sum", "from E select event_id, user_id, sum(cents) as total group by user_id insert into O", f"SELECT event_id, user_id, CAST(sum(cents) {RUN} AS BIGINT) AS total FROM e")
add("running_group_avg", "from E select event_id, avg(cents) as mean group by user_id insert into O", f"SELECT event_id, CAST(sum(cents) {RUN} AS DOUBLE) / count(*) {RUN} AS mean FROM e")
add("running_group_count", "from E select event_id, count() as n group by user_id, event_type insert into O", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e")
add("running_group_minmax", "from E select event_id, min(cents) as lo, max(cents) as hi group by user_id insert into O", f"SELECT event_id, min(cents) {RUN} AS lo, max(cents) {RUN} AS hi FROM e")
add("running_group_distinct", "from E select event_id, distinctCount(event_type) as kinds group by user_id insert into O", f"SELECT event_id, len(list_distinct(list(event_type) {RUN})) AS kinds FROM e")
add("running_group_stddev", "from E select event_id, stdDev(cents) as dev group by user_id insert into S1; from S1 select event_id, cast(dev * 100.0 + 0.5, 'long') as dev insert into O", f"SELECT event_id, CAST(floor(stddev_pop(cents) {RUN} * 100 + 0.5) AS BIGINT) AS dev FROM e")
add("running_group_boolagg", "from E select event_id, and(cents > 100) as every1, or(cents > 9000) as some group by user_id insert into O", f"SELECT event_id, bool_and(cents > 100) {RUN} AS every1, bool_or(cents > 9000) {RUN} AS some FROM e")
add("running_group_unionset", "from E select event_id, sizeOfSet(unionSet(createSet(event_type))) as n group by user_id insert into O", f"SELECT event_id, CAST(len(list_distinct(list(event_type) {RUN})) AS INTEGER) AS n FROM e")
add("group_passthrough", "from E select event_id, user_id group by user_id insert into O", "SELECT event_id, user_id FROM e")
add("having_running", "from E select event_id, user_id, sum(cents) as total group by user_id having total > 100000 and total < 500000 insert into O", f"SELECT * FROM (SELECT event_id, user_id, CAST(sum(cents) {RUN} AS BIGINT) AS total FROM e) WHERE total > 100000 AND total < 500000")
add("min_max_forever", "partition with (user_id of E) begin from E#window.length(2) select event_id, maxForever(cents) as hi, minForever(cents) as lo, max(cents) as recent insert into O; end", f"SELECT event_id, max(cents) {RUN} AS hi, min(cents) {RUN} AS lo, max(cents) OVER ({U} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS recent FROM e")

# Windows
add("win_length_global", "from E#window.length(5) select event_id, sum(cents) as total insert into O", f"SELECT event_id, CAST(sum(cents) OVER ({G} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM e")
add("win_length_group", "from E#window.length(50) select event_id, user_id, sum(cents) as total group by user_id insert into O", f"+ r AS (SELECT *, row_number() OVER ({G}) AS rn FROM e) SELECT event_id, user_id, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY rn RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM r")
add("win_length_partitioned", "partition with (user_id of E) begin from E#window.length(5) select event_id, user_id, sum(cents) as total insert into O; end", f"SELECT event_id, user_id, CAST(sum(cents) OVER ({U} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM e")
HOURS6 = "RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW"
add("win_time", "partition with (user_id of E) begin from E#window.time(6 hours) select event_id, count() as n, sum(cents) as total insert into O; end", f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us {HOURS6}) AS n, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY us {HOURS6}) AS BIGINT) AS total FROM e")
add("win_time_global", "from E#window.time(30 min) select event_id, user_id, count() as n group by user_id insert into O", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS n FROM e")
add("win_external_time", "partition with (user_id of E) begin from E#window.externalTime(ms, 6 hours) select event_id, count() as n insert into O; end", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms, us, event_id RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1 + count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 21599999 PRECEDING AND CURRENT ROW) AS n FROM e")
add("win_time_length", "partition with (user_id of E) begin from E#window.timeLength(12 hours, 3) select event_id, count() as n, sum(cents) as total insert into O; end", f"+ r AS (SELECT *, list(us) OVER w AS u, list(cents) OVER w AS c FROM e WINDOW w AS ({U} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT event_id, len(list_filter(u, lambda x: x > us - 43200000000)) AS n, CAST(list_sum(list_filter(c, lambda x, i: u[i] > us - 43200000000)) AS BIGINT) AS total FROM r")
add("win_length_batch", "partition with (user_id of E) begin from E#window.lengthBatch(4) select user_id, sum(cents) as total, count() as n insert into O; end", f"+ r AS (SELECT *, (row_number() OVER ({U}) - 1) // 4 AS b FROM e) SELECT user_id, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM r GROUP BY user_id, b HAVING count(*) = 4")
add("win_length_batch_events", "from E#window.lengthBatch(7) select event_id insert into O", f"+ r AS (SELECT event_id, row_number() OVER ({G}) - 1 AS n, count(*) OVER () AS c FROM e) SELECT event_id FROM r WHERE n // 7 < c // 7")
add("win_time_batch", "from E#window.timeBatch(1 day) select count() as n, sum(cents) as total, max(event_id) as last insert into O", "+ o AS (SELECT min(us) AS us0 FROM e) SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, max(event_id) AS last FROM e, o GROUP BY (us - us0) // 86400000000")
add("win_time_batch_group", "from E#window.timeBatch(1 day, 0) select event_type, count() as n group by event_type insert into O", "SELECT event_type, count(*) AS n FROM e GROUP BY us // 86400000000, event_type")
add("win_external_time_batch", "from E#window.externalTimeBatch(ms, 2 days, 0) select user_id, max(cents) as hi group by user_id insert into O", "SELECT user_id, max(cents) AS hi FROM e GROUP BY ms // 172800000, user_id")
SESSION = f"+ f AS (SELECT *, CASE WHEN us - lag(us) OVER ({U}) > 21600000000 OR lag(us) OVER ({U}) IS NULL THEN 1 ELSE 0 END AS fresh FROM e), s AS (SELECT *, sum(fresh) OVER ({U} ROWS UNBOUNDED PRECEDING) AS k FROM f)"
add("win_session", "from E#window.session(6 hours, user_id) select user_id, count() as n, sum(cents) as total insert into O", f"{SESSION} SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM s GROUP BY user_id, k")
add("win_delay", "from E#window.delay(1 hour) select event_id, eventTimestamp() as at insert into O", "SELECT event_id, (us + 3600000000) // 1000 AS at FROM e")
add("win_cron", "from E#window.cron('0 0 * * * ?') select count() as n, max(event_id) as last insert into O", "SELECT count(*) AS n, max(event_id) AS last FROM e GROUP BY us // 3600000000")
add("win_sort", "partition with (user_id of E) begin from E#window.sort(3, cents, 'desc') select event_id, sum(cents) as top insert into O; end", f"+ r AS (SELECT event_id, list(cents) {RUN} AS l FROM e) SELECT event_id, CAST(list_sum(list_sort(l, 'DESC')[1:3]) AS BIGINT) AS top FROM r")
# Both walk through the events one by one, with the counters held as a list.
WALK = "+ o AS (SELECT event_id, event_type, row_number() OVER (ORDER BY us, event_id) AS i FROM e)"
KNOWN = "list_contains([h.k for h in held], o.event_type)"
add(
    "win_frequent",
    "from E#window.frequent(3, event_type) select event_id, event_type insert into O",
    f"""{WALK}, walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(k VARCHAR, n BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS event_type, false AS taken
  UNION ALL
  SELECT o.i, CASE
      WHEN {KNOWN} THEN [{{'k': h.k, 'n': h.n + (h.k = o.event_type)::BIGINT}} for h in held]
      WHEN len(held) < 3 THEN list_append(held, {{'k': o.event_type, 'n': CAST(1 AS BIGINT)}})
      WHEN len([h.k for h in held if h.n > 1]) < 3 THEN list_append([{{'k': h.k, 'n': h.n - 1}} for h in held if h.n > 1], {{'k': o.event_type, 'n': CAST(1 AS BIGINT)}})
      ELSE [{{'k': h.k, 'n': h.n - 1}} for h in held] END,
    o.event_id, o.event_type, {KNOWN} OR len(held) < 3 OR len([h.k for h in held if h.n > 1]) < 3
  FROM walk w JOIN o ON o.i = w.i + 1)
SELECT event_id, event_type FROM walk WHERE taken""",
)
add(
    "win_lossy_frequent",
    "from E#window.lossyFrequent(0.1, 0.01, event_type) select event_id, event_type insert into O",
    f"""{WALK}, walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(k VARCHAR, n BIGINT, late BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS event_type
  UNION ALL
  SELECT i, [h for h in held if i % 100 <> 0 OR h.n + h.late > i // 100], event_id, event_type FROM (
    SELECT o.i, CASE WHEN {KNOWN} THEN [{{'k': h.k, 'n': h.n + (h.k = o.event_type)::BIGINT, 'late': h.late}} for h in held]
      ELSE list_append(held, {{'k': o.event_type, 'n': CAST(1 AS BIGINT), 'late': (o.i + 99) // 100 - 1}}) END AS held, o.event_id, o.event_type
    FROM walk w JOIN o ON o.i = w.i + 1))
SELECT event_id, event_type FROM walk WHERE len([h.k for h in held if h.k = event_type AND h.n >= 0.09 * i]) > 0""",
)
add("win_named", "define window W (event_id long, user_id long, cents long) length(10); from E select event_id, user_id, cents insert into W; from W select event_id, sum(cents) as total insert into O", f"SELECT event_id, CAST(sum(cents) OVER ({G} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM e")

# Output kinds, rates, chunks
add("expired_length", "partition with (user_id of E) begin from E#window.length(3) select event_id insert expired events into O; end", f"SELECT event_id FROM (SELECT event_id, lead(event_id, 3) OVER ({U}) AS l FROM e) WHERE l IS NOT NULL")
add("win_cron_days", "from E#window.cron('0 30 6,18 ? * MON-FRI') select count() as n, max(event_id) as last insert into O", "+ f AS (SELECT epoch_us(d + t) AS fire FROM (SELECT unnest(range((SELECT min(ts)::DATE FROM events)::TIMESTAMP, (SELECT max(ts)::DATE FROM events)::TIMESTAMP + INTERVAL 8 DAY, INTERVAL 1 DAY)) AS d), (VALUES (INTERVAL 390 MINUTE), (INTERVAL 1110 MINUTE)) AS v(t) WHERE isodow(d) < 6) SELECT count(*) AS n, max(event_id) AS last FROM (SELECT event_id, (SELECT min(fire) FROM f WHERE fire > us) AS fire FROM e) GROUP BY fire")
add("win_batch", "from E#window.batch() select event_id, sum(cents) as total, count() as n insert into O", "SELECT event_id, cents AS total, CAST(1 AS BIGINT) AS n FROM e")
add("expired_time", "from E#window.time(1 hour) select event_id, eventTimestamp() as at insert expired events into O", "SELECT event_id, (us + 3600000000) // 1000 AS at FROM e")
add("all_events", "from E#window.time(1 hour) select event_id, eventTimestamp() as at insert all events into O", "SELECT event_id, us // 1000 AS at FROM e UNION ALL SELECT event_id, (us + 3600000000) // 1000 FROM e")
NTH = f"+ r AS (SELECT *, row_number() OVER ({G}) - 1 AS n, count(*) OVER () AS c FROM e)"
add("rate_first", "from E select event_id output first every 10 events insert into O", f"{NTH} SELECT event_id FROM r WHERE n % 10 = 0")
add("rate_last", "from E select event_id output last every 10 events insert into O", f"{NTH} SELECT event_id FROM r WHERE n % 10 = 9")
add("rate_all", "from E select event_id output all every 3 events insert into O", f"{NTH} SELECT event_id FROM r WHERE n // 3 < c // 3")
SLOT = "+ o AS (SELECT min(us) AS us0 FROM e), r AS (SELECT e.*, (us - us0) // 3600000000 AS slot FROM e, o)"
add("rate_first_time", "from E select event_id output first every 1 hour insert into O", f"{SLOT} SELECT min(event_id) AS event_id FROM r GROUP BY slot")
add("rate_last_group", "from E select event_id, user_id, sum(cents) as total group by user_id output last every 1 hour insert into O", f"{SLOT}, s AS (SELECT event_id, user_id, slot, CAST(sum(cents) {RUN} AS BIGINT) AS total, row_number() OVER (PARTITION BY user_id, slot ORDER BY us DESC, event_id DESC) AS n FROM r) SELECT event_id, user_id, total FROM s WHERE n = 1")
add("rate_snapshot", "from E select event_id output snapshot every 1 hour insert into O", f"{SLOT}, s AS (SELECT slot, max(event_id) AS event_id, lead(slot) OVER (ORDER BY slot) AS nxt FROM r GROUP BY slot) SELECT event_id FROM (SELECT event_id, unnest(range(slot, coalesce(nxt, slot + 1))) AS t FROM s)")
add("batch_order_limit_offset", "from E#window.lengthBatch(10) select event_id, cents order by cents desc, event_id limit 3 offset 1 insert into O", f"{NTH}, s AS (SELECT event_id, cents, row_number() OVER (PARTITION BY n // 10 ORDER BY cents DESC, event_id) AS p FROM r WHERE n // 10 < c // 10) SELECT event_id, cents FROM s WHERE p > 1 AND p <= 4")

# Joins
SIDES = "+ l AS (SELECT * FROM (SELECT event_id, user_id, cents, us, lead(us, 5) OVER ({U}) AS dead FROM e WHERE event_type = 'click')), r AS (SELECT event_id, user_id, cents, us FROM e WHERE event_type = 'purchase')".replace("{U}", G)
H12 = 43200000000
add("join_length_time", "from Click#window.length(5) as a join Purchase#window.time(12 hours) as b on a.user_id == b.user_id select a.event_id as l, b.event_id as r insert into O", f"{SIDES} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r USING (user_id) WHERE (r.us < l.us AND l.us < r.us + {H12}) OR (l.us < r.us AND (l.dead IS NULL OR r.us < l.dead))")
TWO = "+ l AS (SELECT * FROM e WHERE event_type = 'click'), r AS (SELECT * FROM e WHERE event_type = 'purchase')"
add("join_time_time", "from Click#window.time(12 hours) as a join Purchase#window.time(12 hours) as b on a.user_id == b.user_id select a.event_id as l, b.event_id as r, a.cents + b.cents as total insert into O", f"{TWO} SELECT l.event_id AS l, r.event_id AS r, l.cents + r.cents AS total FROM l JOIN r USING (user_id) WHERE abs(l.us - r.us) < {H12}")
add("join_theta", "from Click#window.time(20 min) as a join Purchase#window.time(20 min) as b on a.cents < b.cents select a.event_id as l, b.event_id as r insert into O", f"{TWO} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r ON l.cents < r.cents AND abs(l.us - r.us) < 1200000000")
add("join_theta_length", "from Click#window.length(3) as a join Purchase#window.length(2) as b on a.cents < b.cents select a.event_id as l, b.event_id as r insert into O", f"+ l AS (SELECT *, lead(us, 3) OVER ({G}) AS dead FROM e WHERE event_type = 'click'), r AS (SELECT *, lead(us, 2) OVER ({G}) AS dead FROM e WHERE event_type = 'purchase') SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r ON l.cents < r.cents AND ((r.us < l.us AND (r.dead IS NULL OR l.us < r.dead)) OR (l.us < r.us AND (l.dead IS NULL OR r.us < l.dead)))")
add("join_unidirectional", "from Click#window.time(12 hours) as a join Purchase#window.time(12 hours) as b unidirectional on a.user_id == b.user_id select a.event_id as l, b.event_id as r insert into O", f"{TWO} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r USING (user_id) WHERE l.us < r.us AND r.us - l.us < {H12}")
LATER = "l.us < r.us AND r.us - l.us < {h}".replace("{h}", str(H12))
EARLIER = "r.us < l.us AND l.us - r.us < {h}".replace("{h}", str(H12))
LEFT = f"SELECT l.event_id AS l, r.event_id AS r FROM l LEFT JOIN r ON l.user_id = r.user_id AND {EARLIER}"
RIGHT = f"SELECT l.event_id AS l, r.event_id AS r FROM r LEFT JOIN l ON l.user_id = r.user_id AND {LATER}"
INNER = "SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r ON l.user_id = r.user_id AND "
J12 = "from Click#window.time(12 hours) as a {k} join Purchase#window.time(12 hours) as b on a.user_id == b.user_id select a.event_id as l, b.event_id as r insert into O"
add("join_left", J12.replace("{k}", "left outer"), f"{TWO} {LEFT} UNION ALL {INNER}{LATER}")
add("join_right", J12.replace("{k}", "right outer"), f"{TWO} {INNER}{EARLIER} UNION ALL {RIGHT}")
add("join_full", J12.replace("{k}", "full outer"), f"{TWO} {LEFT} UNION ALL {RIGHT}")
add("join_no_window", "from Click as a join Purchase#window.time(12 hours) as b on a.user_id == b.user_id select a.event_id as l, b.event_id as r insert into O", f"{TWO} {INNER}{EARLIER}")
add("join_self", "from E#window.time(1 hour) as a join E#window.time(1 hour) as b on a.user_id == b.user_id and a.event_id < b.event_id select a.event_id as l, b.event_id as r insert into O", "SELECT l.event_id AS l, r.event_id AS r FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_id < r.event_id AND r.us - l.us < 3600000000")
add("join_within", "from Click#window.length(50) as a join Purchase#window.length(50) as b on a.user_id == b.user_id within 1 hour select a.event_id as l, b.event_id as r insert into O", f"+ l AS (SELECT *, lead(us, 50) OVER ({G}) AS dead FROM e WHERE event_type = 'click'), r AS (SELECT *, lead(us, 50) OVER ({G}) AS dead FROM e WHERE event_type = 'purchase') SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r ON l.user_id = r.user_id AND abs(l.us - r.us) <= 3600000000 AND ((r.us < l.us AND (r.dead IS NULL OR l.us < r.dead)) OR (l.us < r.us AND (l.dead IS NULL OR r.us < l.dead)))")
add("join_group_sum", "from Click#window.time(12 hours) as a join Purchase#window.time(12 hours) as b on a.user_id == b.user_id select b.user_id as user_id, count() as n group by b.user_id insert into C; from C select user_id, n insert into O", f"{TWO} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY l.event_id) AS n FROM l JOIN r USING (user_id) WHERE abs(l.us - r.us) < {H12}")

add("join_aggregation", "define aggregation A from E select user_id, sum(cents) as total group by user_id aggregate every hour...month; from Signup join A on Signup.user_id == A.user_id within 0L, 1705276800000L per 'days' select Signup.event_id as id, A.AGG_TIMESTAMP as day, A.total as total insert into O", "+ a AS (SELECT us // 86400000000 * 86400000 AS day, user_id, CAST(sum(cents) AS BIGINT) AS total FROM e GROUP BY 1, 2) SELECT event_id AS id, day, total FROM e JOIN a USING (user_id) WHERE event_type = 'signup' AND day < 1705276800000")
add("join_named_window", "define window W (event_id long, user_id long) time(12 hours); from Click select event_id, user_id insert into W; from W join Purchase#window.time(12 hours) as b on W.user_id == b.user_id select W.event_id as l, b.event_id as r insert into O", f"{TWO} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r USING (user_id) WHERE abs(l.us - r.us) < {H12}")

# Tables
add("table_insert_join", "define table T (k long, nation int, bal double); from Customers select c_custkey, c_nationkey, c_acctbal insert into T; from E join T on E.user_id == T.k select E.event_id as id, T.nation as nation insert into O", "SELECT event_id AS id, c_nationkey AS nation FROM e JOIN customer ON user_id = c_custkey")
VERSION = f"+ v AS (SELECT user_id AS k, cents AS price, us, lead(us) OVER ({U}) AS dead FROM e WHERE event_type = 'view')"
add("table_upsert_join", "define table T (k long, price long); from View select user_id as k, cents as price update or insert into T on T.k == k; from Purchase join T on Purchase.user_id == T.k select Purchase.event_id as id, T.price as price insert into O", f"{VERSION} SELECT e.event_id AS id, price FROM e JOIN v ON e.user_id = v.k AND v.us < e.us AND (dead IS NULL OR e.us < dead) WHERE event_type = 'purchase'")
add("table_update", "define table T (k long, price long); from Signup select user_id as k, cents as price update or insert into T on T.k == k; from View select user_id as k, cents as price update T set T.price = price on T.k == k; from Purchase join T on Purchase.user_id == T.k select Purchase.event_id as id, T.price as price insert into O", f"+ c AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) {RUN} AS born FROM e WHERE event_type IN ('signup', 'view')), v AS (SELECT user_id AS k, cents AS price, us, born, lead(us) OVER ({U}) AS dead FROM c) SELECT e.event_id AS id, price FROM e JOIN v ON e.user_id = v.k AND v.us < e.us AND (dead IS NULL OR e.us < dead) WHERE event_type = 'purchase' AND born = 1")
add("table_delete", "define table T (k long, price long); from View select user_id as k, cents as price update or insert into T on T.k == k; from Fault select user_id as k delete T on T.k == k; from Purchase join T on Purchase.user_id == T.k select Purchase.event_id as id, T.price as price insert into O", f"+ v AS (SELECT user_id AS k, event_type, cents AS price, us, lead(us) OVER ({U}) AS dead FROM e WHERE event_type IN ('view', 'error')) SELECT e.event_id AS id, price FROM e JOIN v ON e.user_id = v.k AND v.us < e.us AND (dead IS NULL OR e.us < dead) AND v.event_type = 'view' WHERE e.event_type = 'purchase'")
add("table_in", "define table T (k long); from Signup select user_id as k insert into T; from Purchase[(T.k == user_id) in T] select event_id insert into O", "SELECT event_id FROM e p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM e s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.us < p.us)")
add("table_not_in", "define table T (k long); from Signup select user_id as k insert into T; from Purchase[not ((T.k == user_id) in T)] select event_id insert into O", "SELECT event_id FROM e p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM e s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.us < p.us)")

# Partitions
add("partition_value", "partition with (user_id of E) begin from E select event_id, count() as n insert into O; end", f"SELECT event_id, count(*) {RUN} AS n FROM e")
add("partition_range", "partition with (cents < 3000 as 'low' or cents < 7000 as 'mid' of E) begin from E select event_id, count() as n insert into O; end", f"SELECT event_id, count(*) OVER (PARTITION BY cents < 3000 {G} ROWS UNBOUNDED PRECEDING) AS n FROM e WHERE cents < 7000")
add("partition_inner_stream", "partition with (user_id of E) begin from E select event_id, user_id, sum(cents) as total insert into #M; from #M#window.length(2) select event_id, max(total) as top insert into O; end", f"+ m AS (SELECT event_id, user_id, us, CAST(sum(cents) {RUN} AS BIGINT) AS total FROM e) SELECT event_id, max(total) OVER ({U} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS top FROM m")

# Patterns
NEXT = "OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
FIRST = f"first_value(CASE WHEN event_type = '{{t}}' THEN event_id END IGNORE NULLS) {NEXT}"
BYUSER = "partition with (user_id of E) begin from {p} end"
EVERY = "every a=E[event_type == 'click'] -> b=E[event_type == 'purchase']"
add("pat_every_ab", BYUSER.replace("{p}", f"{EVERY} select a.event_id as a, b.event_id as b insert into O;"), f"SELECT event_id AS a, b FROM (SELECT event_id, event_type, {FIRST.replace('{t}', 'purchase')} AS b FROM e) WHERE event_type = 'click' AND b IS NOT NULL")
add("pat_first_ab", BYUSER.replace("{p}", "a=E[event_type == 'click'] -> b=E[event_type == 'purchase'] select a.event_id as a, b.event_id as b insert into O;"), f"SELECT min(event_id) AS a, min_by(b, event_id) AS b FROM (SELECT user_id, event_id, event_type, {FIRST.replace('{t}', 'purchase')} AS b FROM e) WHERE event_type = 'click' AND b IS NOT NULL GROUP BY user_id")
add("pat_abc", BYUSER.replace("{p}", f"{EVERY} -> c=E[event_type == 'view'] select a.event_id as a, b.event_id as b, c.event_id as c insert into O;"), f"+ n AS (SELECT event_id, event_type, {FIRST.replace('{t}', 'purchase')} AS b, {FIRST.replace('{t}', 'view')} AS v FROM e) SELECT x.event_id AS a, x.b, y.v AS c FROM n x JOIN n y ON x.b = y.event_id WHERE x.event_type = 'click' AND y.v IS NOT NULL")
add("pat_correlated", BYUSER.replace("{p}", "every a=E[event_type == 'click'] -> b=E[event_type == 'purchase' and cents > a.cents] select a.event_id as a, b.event_id as b insert into O;"), "SELECT a.event_id AS a, min(b.event_id) AS b FROM e a JOIN e b ON a.user_id = b.user_id AND b.us > a.us AND b.cents > a.cents AND b.event_type = 'purchase' WHERE a.event_type = 'click' GROUP BY a.event_id")
add("pat_within", BYUSER.replace("{p}", f"{EVERY} within 6 hours select a.event_id as a, b.event_id as b insert into O;"), f"+ n AS (SELECT event_id, us, event_type, {FIRST.replace('{t}', 'purchase')} AS b FROM e) SELECT x.event_id AS a, x.b FROM n x JOIN e y ON x.b = y.event_id WHERE x.event_type = 'click' AND y.us - x.us <= 21600000000")
add("pat_cross_stream", "from every a=Click[cents > 9000] -> b=Purchase[cents > 9000] select a.event_id as id_1, b.event_id as id_2 insert into O", f"SELECT event_id AS id_1, b AS id_2 FROM (SELECT event_id, event_type, cents, first_value(CASE WHEN event_type = 'purchase' AND cents > 9000 THEN event_id END IGNORE NULLS) OVER ({G} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM e) WHERE event_type = 'click' AND cents > 9000 AND b IS NOT NULL")
add("pat_every_group", BYUSER.replace("{p}", "every (a=E[event_type == 'click'] -> b=E[event_type == 'purchase']) select a.event_id as a, b.event_id as b insert into O;"), f"+ n AS (SELECT user_id, event_id, event_type, {FIRST.replace('{t}', 'purchase')} AS b FROM e), x AS (SELECT * FROM n WHERE event_type = 'click' AND b IS NOT NULL) SELECT min(event_id) AS a, b FROM x GROUP BY b")
# A user's clicks by the purchase that closes their stretch: of two, all pairs in a row; of two or more, all since the
# last match, where a single one waits for the next stretch; of one to three, a new attempt at every third.
CLOSED = """+ s AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM e WHERE event_type IN ('click', 'purchase')),
closing AS (SELECT user_id, seg, event_id AS b FROM s WHERE event_type = 'purchase'),
clicks AS (SELECT user_id, seg, event_id, row_number() OVER (PARTITION BY user_id, seg ORDER BY us, event_id) AS pos, lead(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next_id, lead(seg) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next_seg FROM s WHERE event_type = 'click')"""
add("pat_count", BYUSER.replace("{p}", "every a=E[event_type == 'click']<2> -> b=E[event_type == 'purchase'] select a[0].event_id as a0, a[1].event_id as a1, b.event_id as b insert into O;"), f"{CLOSED} SELECT c.event_id AS a0, c.next_id AS a1, p.b FROM clicks c JOIN closing p ON c.user_id = p.user_id AND c.next_seg = p.seg")
add("pat_count_min", BYUSER.replace("{p}", "every a=E[event_type == 'click']<2:> -> b=E[event_type == 'purchase'] select a[0].event_id as first, a[last].event_id as last, b.event_id as b insert into O;"), f"""{CLOSED}, parts AS (SELECT p.user_id, p.seg, p.b, count(c.event_id) AS n, arg_min(c.event_id, c.pos) AS first, arg_max(c.event_id, c.pos) AS last FROM closing p LEFT JOIN clicks c USING (user_id, seg) GROUP BY ALL),
walk AS (SELECT user_id, seg, b, n >= 2 AS enough, first, last, CASE WHEN n = 1 THEN first END AS held FROM parts WHERE seg = 0
  UNION ALL
  SELECT p.user_id, p.seg, p.b, p.n + (w.held IS NOT NULL)::INT >= 2, coalesce(w.held, p.first), p.last, CASE WHEN p.n + (w.held IS NOT NULL)::INT = 1 THEN coalesce(w.held, p.first) END
  FROM walk w JOIN parts p ON p.user_id = w.user_id AND p.seg = w.seg + 1)
SELECT first, last, b FROM walk WHERE enough""")
add("pat_count_max", BYUSER.replace("{p}", "every a=E[event_type == 'click']<1:3> -> b=E[event_type == 'purchase'] select a[0].event_id as first, a[last].event_id as last, b.event_id as b insert into O;"), f"{CLOSED}, runs AS (SELECT user_id, seg, pos, event_id AS first, coalesce(lead(event_id, 2) OVER w, lead(event_id, 1) OVER w, event_id) AS last FROM clicks WINDOW w AS (PARTITION BY user_id, seg ORDER BY pos)) SELECT first, last, b FROM runs JOIN closing USING (user_id, seg) WHERE pos % 2 = 1")
add("pat_and", BYUSER.replace("{p}", "every a=E[event_type == 'click'] -> b=E[event_type == 'purchase'] and c=E[event_type == 'view'] select a.event_id as a, b.event_id as b, c.event_id as c insert into O;"), f"SELECT event_id AS a, b, c FROM (SELECT event_id, event_type, {FIRST.replace('{t}', 'purchase')} AS b, {FIRST.replace('{t}', 'view')} AS c FROM e) WHERE event_type = 'click' AND b IS NOT NULL AND c IS NOT NULL")
add("pat_or", BYUSER.replace("{p}", "every a=E[event_type == 'click'] -> b=E[event_type == 'purchase'] or c=E[event_type == 'view'] select a.event_id as a, b.event_id as b, c.event_id as c insert into O;"), f"SELECT event_id AS a, CASE WHEN c IS NULL OR b < c THEN b END AS b, CASE WHEN b IS NULL OR c < b THEN c END AS c FROM (SELECT event_id, event_type, {FIRST.replace('{t}', 'purchase')} AS b, {FIRST.replace('{t}', 'view')} AS c FROM e) WHERE event_type = 'click' AND (b IS NOT NULL OR c IS NOT NULL)")
add("pat_absent_for", BYUSER.replace("{p}", "every a=E[event_type == 'click'] -> not E[event_type == 'purchase'] for 1 day select a.event_id as a insert into O;"), f"+ n AS (SELECT event_id, us, event_type, {FIRST.replace('{t}', 'purchase')} AS b FROM e) SELECT x.event_id AS a FROM n x LEFT JOIN e y ON x.b = y.event_id WHERE x.event_type = 'click' AND (y.us IS NULL OR y.us >= x.us + 86400000000)")
add("pat_absent_and", BYUSER.replace("{p}", "every a=E[event_type == 'click'] -> not E[event_type == 'error'] and b=E[event_type == 'purchase'] select a.event_id as a, b.event_id as b insert into O;"), f"SELECT event_id AS a, b FROM (SELECT event_id, event_type, {FIRST.replace('{t}', 'purchase')} AS b, {FIRST.replace('{t}', 'error')} AS x FROM e) WHERE event_type = 'click' AND b IS NOT NULL AND (x IS NULL OR b < x)")
add("pat_group_by", "from every a=Click[cents > 5000] -> b=Purchase[cents > 5000] select b.event_id as b, count() as n group by b.event_id insert into O", f"+ n AS (SELECT event_id AS a, event_type, cents, first_value(CASE WHEN event_type = 'purchase' AND cents > 5000 THEN event_id END IGNORE NULLS) OVER ({G} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM e) SELECT b, row_number() OVER (PARTITION BY b ORDER BY a) AS n FROM n WHERE event_type = 'click' AND cents > 5000 AND b IS NOT NULL")

# Sequences
SEQ = f"lead(event_type) OVER ({U}) AS t1, lead(event_id) OVER ({U}) AS e1, lead(us) OVER ({U}) AS u1"
add("seq_ab", BYUSER.replace("{p}", "every a=E[event_type == 'click'], b=E[event_type == 'purchase'] select a.event_id as a, b.event_id as b insert into O;"), f"SELECT event_id AS a, e1 AS b FROM (SELECT event_id, event_type, {SEQ} FROM e) WHERE event_type = 'click' AND t1 = 'purchase'")
add("seq_within", BYUSER.replace("{p}", "every a=E[event_type == 'click'], b=E[event_type == 'purchase'] within 6 hours select a.event_id as a, b.event_id as b insert into O;"), f"SELECT event_id AS a, e1 AS b FROM (SELECT event_id, us, event_type, {SEQ} FROM e) WHERE event_type = 'click' AND t1 = 'purchase' AND u1 - us <= 21600000000")
RUNS = f"+ x AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER ({U} ROWS UNBOUNDED PRECEDING) AS g, {SEQ} FROM e)"
ENDS = "SELECT min(event_id) AS first, max(event_id) AS last, max_by(CASE WHEN t1 = 'purchase' THEN e1 END, event_id) AS b FROM x WHERE event_type = 'click' GROUP BY user_id, g"
PLUS = "every a=E[event_type == 'click']+, b=E[event_type == 'purchase']"
add("seq_plus_opt", BYUSER.replace("{p}", f"{PLUS}? select a[0].event_id as first, a[last].event_id as last, b.event_id as b insert into O;"), f"{RUNS} {ENDS}".replace("max_by(CASE WHEN t1 = 'purchase' THEN e1 END, event_id)", "max(CASE WHEN t1 = 'purchase' THEN e1 END)"))
add("seq_capture_index", BYUSER.replace("{p}", f"{PLUS} select a[0].event_id as first, a[1].event_id as second, b.event_id as b insert into O;"), f"{RUNS} SELECT * FROM (SELECT min(event_id) AS first, list(event_id ORDER BY event_id)[2] AS second, max(CASE WHEN t1 = 'purchase' THEN e1 END) AS b FROM x WHERE event_type = 'click' GROUP BY user_id, g) WHERE b IS NOT NULL")
add("seq_star", BYUSER.replace("{p}", "every a=E[event_type == 'view'], b=E[event_type == 'click']*, c=E[event_type == 'purchase'] select a.event_id as a, c.event_id as c insert into O;"), f"+ x AS (SELECT event_id, user_id, us, event_type, first_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) {NEXT} AS c FROM e) SELECT x.event_id AS a, x.c FROM x JOIN e y ON x.c = y.event_id WHERE x.event_type = 'view' AND y.event_type = 'purchase'")


def aggregation(unit: str) -> None:
    span = "week" if unit == "week" else "sec...year"  # a range of units has no weeks
    text = f"define aggregation A from E select user_id, sum(cents) as total, count() as n group by user_id aggregate every {span}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Execution(environment(spark, sf_dir), _parsed(text)).aggregation("A", unit)

    QUERIES[f"agg_incremental_{unit}"] = run
    ORACLES[f"agg_incremental_{unit}"] = f"SELECT epoch_ms(CAST(date_trunc('{ {'sec': 'second', 'min': 'minute'}.get(unit, unit)}', ts) AS TIMESTAMP)) AS \"AGG_TIMESTAMP\", user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1, 2"


for _unit in ("sec", "min", "hour", "day", "week", "month", "year"):
    aggregation(_unit)

# Trigger, control, conversion
SPAN = "+ s AS (SELECT min(us) AS a, max(us) AS b FROM e)"


def controlled(name: str, events_: list, sql: str, text: str = "from E select event_id, sum(cents) as total insert into O") -> None:
    """events_: functions from the middle and the three-quarter time of the data to control events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        registry = control.PlanRegistry(environment(spark, sf_dir))
        for e in events_:
            registry.apply(e)
        return registry.returns("O")

    QUERIES[name] = run
    ORACLES[name] = f"{BASE} {sql}"


DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01
PLAN = "from E select event_id, sum(cents) as total insert into O"
RUNG = f"CAST(sum(cents) OVER ({G} ROWS UNBOUNDED PRECEDING) AS BIGINT)"
_d = lambda n: START + n * DAY
controlled("control_add_disable", [control.MetadataEvent(_d(3), added={"p": PLAN}), control.OperationEvent(_d(10), action="disable", plan="p"), control.OperationEvent(_d(20), action="enable", plan="p")], f"SELECT event_id, {RUNG} AS total FROM e WHERE us >= {_d(3)} AND NOT (us >= {_d(10)} AND us < {_d(20)})")
controlled("control_update", [control.MetadataEvent(_d(3), added={"p": PLAN}), control.MetadataEvent(_d(15), updated={"p": PLAN})], f"SELECT event_id, CAST(sum(cents) OVER (PARTITION BY us >= {_d(15)} {G} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e WHERE us >= {_d(3)}")
controlled("control_delete", [control.MetadataEvent(_d(3), added={"p": PLAN}), control.MetadataEvent(_d(15), deleted=("p",))], f"SELECT event_id, {RUNG} AS total FROM e WHERE us >= {_d(3)} AND us < {_d(15)}")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control as a table of JSON messages, in no order."""
    env, e = CEPEnvironment(spark), events(spark, sf_dir)
    env.register_stream("E", e, *FIELDS, ts="ts", seq="event_id")
    made = [control.MetadataEvent(_d(15), deleted=("p",)), control.OperationEvent(_d(10), action="enable", plan="p"), control.MetadataEvent(_d(3), added={"p": PLAN}), control.OperationEvent(_d(5), action="disable", plan="p")]
    registry = control.PlanRegistry(env)
    registry.replay(spark.createDataFrame([(control.encode(m),) for m in made], "value string"))
    return registry.returns("O")


QUERIES["control_messages"] = _messages
ORACLES["control_messages"] = f"{BASE} SELECT event_id, {RUNG} AS total FROM e WHERE us >= {_d(3)} AND us < {_d(5)} OR us >= {_d(10)} AND us < {_d(15)}"


def _trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    env, e = CEPEnvironment(spark), events(spark, sf_dir)
    env.register_stream("E", e, *FIELDS, ts="ts", seq="event_id")
    return Execution(env, _parsed("define trigger T at every 6 hours; from T select triggered_time insert into O")).returns("O")


QUERIES["trigger_every"] = _trigger
ORACLES["trigger_every"] = f"{BASE}, s AS (SELECT min(us) AS a, max(us) AS b FROM e) SELECT t // 1000 AS triggered_time FROM (SELECT unnest(range(a, b + 1, 21600000000)) AS t FROM s)"


def _as_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Execution(environment(spark, sf_dir), _parsed("from E select event_id as zeta, user_id as alpha insert into O")).returns_map("O")
    return made.select(F.map_keys("record")[0].alias("first_key"), F.map_keys("record")[1].alias("second_key"), F.col("record")["zeta"].alias("zeta"), F.col("record")["alpha"].alias("alpha"))


QUERIES["return_map"] = _as_map
ORACLES["return_map"] = f"{BASE} SELECT 'alpha' AS first_key, 'zeta' AS second_key, event_id AS zeta, user_id AS alpha FROM e"


def _as_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    wanted = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("cents", T.DoubleType()), T.StructField("missing", T.IntegerType())])
    return Execution(environment(spark, sf_dir), _parsed("from E select event_id, user_id, cents insert into O")).returns_as("O", wanted)


QUERIES["return_as_schema"] = _as_schema
ORACLES["return_as_schema"] = f"{BASE} SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(cents AS DOUBLE) AS cents, CAST(NULL AS INTEGER) AS missing FROM e"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Execution(environment(spark, sf_dir), _parsed("from Click select event_id insert into A; from Purchase select event_id, cents insert into B")).returns_tagged("A", "B")
    return made.select("stream_id", F.col("payload")["event_id"].alias("event_id"), F.col("payload")["cents"].alias("cents"))


QUERIES["return_tagged"] = _tagged
ORACLES["return_tagged"] = f"{BASE} SELECT 'A' AS stream_id, CAST(event_id AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS cents FROM e WHERE event_type = 'click' UNION ALL SELECT 'B', CAST(event_id AS VARCHAR), CAST(cents AS VARCHAR) FROM e WHERE event_type = 'purchase'"


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = CEPEnvironment(spark)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    env.register_stream("Orders", read("orders"), "o_orderkey", "o_custkey", ts="o_orderdate", seq="o_orderkey")
    env.register_stream("Lines", read("lineitem").withColumn("n", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_orderkey", "l_linenumber", "l_quantity", ts="l_shipdate", seq="n")
    q = "from Orders#window.time(60 days) as o join Lines#window.time(1 day) as l on o.o_orderkey == l.l_orderkey select o.o_custkey as cust, l.l_orderkey as ord, l.l_linenumber as line insert into O"
    return Execution(env, _parsed(q)).returns("O")


QUERIES["star_stream_join"] = _star
ORACLES["star_stream_join"] = "SELECT o_custkey AS cust, l_orderkey AS ord, l_linenumber AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE (l_shipdate >= o_orderdate AND epoch_us(l_shipdate) - epoch_us(o_orderdate) < 60 * 86400000000) OR (l_shipdate < o_orderdate AND epoch_us(o_orderdate) - epoch_us(l_shipdate) < 86400000000)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click followed by a purchase of the same user."""
    return QUERIES["pat_every_ab"](spark, sf_dir)


# Streaming replays of queries above: the same rows
def streamed(name: str, cql: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import tempfile
        import uuid

        from rillcep.sources import connectors
        from rillcep.streaming import execute

        path = f"{sf_dir}/events.parquet"
        batch = spark.read.parquet(path)
        e = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
        e = e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), ms.alias("ms"), "ts")
        env = CEPEnvironment(spark)
        env.register_stream("E", e, *FIELDS, ts="ts", seq="event_id")
        for n, kind in KINDS.items():
            env.register_stream(n, e.where(F.col("event_type") == kind), *FIELDS, ts="ts", seq="event_id")
        base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='rillcep-')}"
        at = f"{base}/stream-{uuid.uuid4().hex}"
        out = execute.stream(env, cql, "O", reorder=False)
        connectors.write_parquet_once(out, f"{at}/out", f"{at}/checkpoint")
        return spark.read.schema(out.schema).parquet(f"{at}/out")

    QUERIES[name] = run
    ORACLES[name] = ORACLES[oracle]


def _reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come up to a day late, file by file, put in order behind a watermark of two days."""
    import tempfile
    import uuid

    from rillcep.sources import connectors
    from rillcep.streaming import execute

    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='rillcep-')}"
    at = f"{base}/stream-{uuid.uuid4().hex}"
    e = events(spark, sf_dir).withColumn("arrival", F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(DAY)))
    first, last = e.agg(F.min("arrival"), F.max("arrival")).first()
    step = (last - first) // 5 + 1
    for k in range(5):
        part = e.where(F.floor((F.col("arrival") - first) / step) == k).orderBy(F.desc("arrival")).drop("arrival")
        part.coalesce(1).write.parquet(f"{at}/in/part{k}")
    env = CEPEnvironment(spark)
    rows = spark.readStream.schema(e.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    env.register_stream("E", rows, *FIELDS, ts="ts", seq="event_id")
    out = execute.stream(env, "partition with (user_id of E) begin from E select event_id, user_id, sum(cents) as total insert into O; end", "O", delay="2 days")
    connectors.write_parquet_once(out, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{at}/out")


QUERIES["stream_reorder"] = _reordered
#: What the watermark hasn't passed at the end stays in the queue.
ORACLES["stream_reorder"] = f"{BASE}, b AS (SELECT (max(us) // 1000 - 172800000) * 1000 AS edge FROM e) SELECT event_id, user_id, CAST(sum(cents) OVER ({U} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e WHERE us < (SELECT edge FROM b)"

streamed("stream_filter", "from E[event_type == 'click' and cents > 2500] select event_id, cents insert into O", "filter_simple")
streamed("stream_running_sum", "partition with (user_id of E) begin from E select event_id, user_id, sum(cents) as total insert into O; end", "running_group_sum")
streamed("stream_length_window", "partition with (user_id of E) begin from E#window.length(5) select event_id, user_id, sum(cents) as total insert into O; end", "win_length_partitioned")
streamed("stream_join_time_time", "from Click#window.time(12 hours) as a join Purchase#window.time(12 hours) as b on a.user_id == b.user_id select a.event_id as l, b.event_id as r, a.cents + b.cents as total insert into O", "join_time_time")
streamed("stream_pattern", BYUSER.replace("{p}", f"{EVERY} select a.event_id as a, b.event_id as b insert into O;"), "pat_every_ab")
streamed("stream_sequence", BYUSER.replace("{p}", "every a=E[event_type == 'click'], b=E[event_type == 'purchase'] select a.event_id as a, b.event_id as b insert into O;"), "seq_ab")

CHAIN = "partition with (user_id of E) begin from E[event_type == 'click' or event_type == 'purchase'] select event_id, event_type, cents insert into #A; from every a=#A[event_type == 'click'], b=#A[event_type == 'purchase'] select a.event_id as a, b.event_id as b, b.cents as cents insert into #B; from #B#window.length(3) select a, b, sum(cents) as total insert into O; end"
CHAIN_SQL = f"+ x AS (SELECT * FROM e WHERE event_type IN ('click', 'purchase')), y AS (SELECT user_id, event_id AS a, lead(event_id) OVER ({U}) AS b, lead(event_type) OVER ({U}) AS kind, lead(cents) OVER ({U}) AS cents, us, event_id FROM x), z AS (SELECT y.* FROM y JOIN x ON x.event_id = y.a WHERE x.event_type = 'click' AND kind = 'purchase') SELECT a, b, CAST(sum(cents) OVER ({U} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM z"
add("chain_inner", CHAIN, CHAIN_SQL)
streamed("stream_chain", CHAIN, "chain_inner")
