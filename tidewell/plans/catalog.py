"""Every query over the test data, with its SQL where SQL can say it. The queries only bind parameters; the operators are elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import codecs
from tidewell.functions.bounds import cms_bounds, cms_size, hll_alpha, hll_error
from tidewell.functions.scalar import instant_text, item_key, json_string, normalized, url_part, write_shard
from tidewell.operators import ingest, metrics, routing, sketches, validate
from tidewell.plans import stats
from tidewell.session import shared_folder
from tidewell.sources import events as src
from tidewell.streaming import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TENANT, START, END = "t1", "2024-01-05", "2024-01-11"

EV = r"""ev AS (
  SELECT 't' || CAST(user_id % 4 AS VARCHAR) AS tenant_id, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS distinct_id,
    CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS name,
    CASE WHEN k % 10 = 0 THEN '{"path":' || CAST(k AS VARCHAR) || '}' ELSE '{"path":"/p/' || CAST(k AS VARCHAR) || '"}' END AS properties,
    ts AS occurred_at, CAST(ts AS DATE) AS day, event_id // 100 AS batch_id,
    CASE WHEN event_id % 10 = 0 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS received_day, event_id AS n, value
  FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events)
)"""
DV = EV + """, dv AS (
  SELECT * FROM ev UNION ALL SELECT * REPLACE (batch_id + 1000 AS batch_id) FROM ev WHERE n % 7 = 0
)"""
OWNED = DV + """, own AS (
  SELECT * FROM (SELECT *, min(batch_id) OVER (PARTITION BY tenant_id, event_id, occurred_at) AS owner FROM dv) WHERE batch_id = owner
)"""
IN_RANGE = f"tenant_id = '{TENANT}' AND occurred_at >= TIMESTAMP '{START} 00:00:00' AND occurred_at < TIMESTAMP '{END} 00:00:00' + INTERVAL 1 DAY"
PAGE = "CASE WHEN json_type(properties, '$.path') = 'VARCHAR' THEN json_extract_string(properties, '$.path') END"
ITEMS = EV + f""", items AS (
  SELECT tenant_id, day, kind, item, CAST(count(*) AS BIGINT) AS n FROM (
    SELECT tenant_id, day, 'users' AS kind, distinct_id AS item FROM ev UNION ALL SELECT tenant_id, day, 'events', name FROM ev
    UNION ALL SELECT tenant_id, day, 'pages', {PAGE} FROM ev WHERE name = 'page_view'
  ) WHERE item IS NOT NULL GROUP BY ALL
)"""
AT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')".format


def registers_sql(source: str, item: str, keys: str, p: int) -> str:
    bits = f"lpad(bin(CAST('0x' || substr(md5({item}), 1, 16) AS UBIGINT)), 64, '0')"
    rest = f"substr({bits}, {p + 1})"
    return f"""SELECT {keys}, CAST(CAST('0b' || substr({bits}, 1, {p}) AS UBIGINT) AS INTEGER) AS idx,
      CAST(max(CASE WHEN instr({rest}, '1') = 0 THEN {64 - p + 1} ELSE instr({rest}, '1') END) AS INTEGER) AS rank FROM {source} GROUP BY ALL"""


def estimate_sql(registers: str, keys: str, p: int) -> str:
    m = 1 << p
    raw = f"({hll_alpha(m) * m * m!r} / ({m} - n + s))"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {keys + ',' if keys else ''} CASE WHEN {raw} <= {2.5 * m} AND n < {m} THEN {m} * ln({float(m)} / ({m} - n)) ELSE {raw} END AS estimate
      FROM (SELECT {keys + ',' if keys else ''} sum(pow(2.0, -rank)) AS s, count(*) AS n FROM {registers} {group})"""


def cells_sql(items: str, keys: str, width: int, depth: int) -> str:
    h = lambda a: f"CAST(CAST('0x' || substr(md5(item), {a}, 8) AS UBIGINT) AS BIGINT)"
    return f"""SELECT {keys + ',' if keys else ''} CAST(r AS INTEGER) AS row, ({h(1)} + r * ({h(9)} | 1)) % {width} AS col, CAST(sum(n) AS BIGINT) AS total
      FROM {items}, range({depth}) AS x(r) GROUP BY ALL"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _range(spark: SparkSession, d: str) -> DataFrame:
    return src.scan(src.canonical(spark, d), TENANT, START, END)


# Scans and exact statistics


@query(f"WITH {EV} SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT distinct_id) AS BIGINT) AS unique_users FROM ev WHERE {IN_RANGE}")
def stats_totals(spark, d):
    return stats.totals(_range(spark, d))


@query(f"WITH {EV} SELECT name AS key, CAST(count(*) AS BIGINT) AS count FROM ev WHERE {IN_RANGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_events(spark, d):
    return stats.top_events(_range(spark, d))


@query(f"WITH {EV} SELECT {PAGE} AS key, CAST(count(*) AS BIGINT) AS count FROM ev WHERE {IN_RANGE} AND name = 'page_view' AND {PAGE} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_pages(spark, d):
    return stats.top_pages(_range(spark, d))


@query(f"""WITH {EV}, w AS (SELECT *, '{{"properties":' || properties || '}}' AS wrapped FROM ev WHERE {IN_RANGE}),
t AS (SELECT 'events' AS kind, name AS key FROM w UNION ALL SELECT 'pages', CASE WHEN json_type(wrapped, '$.properties.path') = 'VARCHAR' THEN json_extract_string(wrapped, '$.properties.path') END FROM w WHERE name = 'page_view'),
c AS (SELECT kind, key, CAST(count(*) AS BIGINT) AS count FROM t WHERE key IS NOT NULL GROUP BY ALL)
SELECT kind, key, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, key) AS rank FROM c) WHERE rank <= 10""")
def stats_exact_store(spark, d):
    """Top events and pages where properties are stored wrapped, as key-value items hold them."""
    w = _range(spark, d).withColumn("wrapped", F.concat(F.lit('{"properties":'), "properties", F.lit("}")))
    page = F.when(F.col("name") == "page_view", json_string(F.col("wrapped"), "properties.path"))
    rows = w.select(F.explode(F.array(F.struct(F.lit("events").alias("kind"), F.col("name").alias("key")), F.struct(F.lit("pages").alias("kind"), page.alias("key")))).alias("x")).select("x.*").where("key is not null")
    return sketches.top(rows.groupBy("kind", "key").agg(F.count("*").alias("count")), ["kind"], "key", "count", 10)


@query(f"WITH {EV} SELECT event_id, name, {AT('occurred_at')} AS at FROM ev WHERE {IN_RANGE}")
def range_filter(spark, d):
    return _range(spark, d).select("event_id", "name", instant_text(F.col("occurred_at")).alias("at"))


@query(f"WITH {EV} SELECT day, event_id, distinct_id, properties FROM ev WHERE tenant_id = '{TENANT}' AND day BETWEEN DATE '{START}' AND DATE '{END}'")
def scan_range(spark, d):
    return stats.in_days(src.canonical(spark, d), TENANT, START, END).select("day", "event_id", "distinct_id", "properties")


_SHARD = "CAST(CAST('0x' || substr(md5(event_id), 1, 8) AS UBIGINT) % 8 AS BIGINT)"


@query(f"WITH {EV} SELECT event_id, {_SHARD} AS shard FROM ev")
def write_shard_(spark, d):
    return src.canonical(spark, d).select("event_id", write_shard(F.col("event_id")).alias("shard"))


QUERIES["write_shard"], ORACLES["write_shard"] = QUERIES.pop("write_shard_"), ORACLES.pop("write_shard_")


@query(f"WITH {EV} SELECT tenant_id || '#' || CAST(day AS VARCHAR) || '#' || CAST({_SHARD} AS VARCHAR) AS pk, {AT('occurred_at')} || '#' || event_id AS sk FROM ev")
def item_keys(spark, d):
    ev = src.canonical(spark, d)
    return ev.select(item_key(F.col("tenant_id"), F.col("day"), write_shard(F.col("event_id"))).alias("pk"), F.concat_ws("#", instant_text(F.col("occurred_at")), "event_id").alias("sk"))


@query(f"WITH {EV} SELECT event_id, name FROM ev WHERE tenant_id = '{TENANT}' AND day = DATE '{START}' AND {_SHARD} = 3")
def scan_shard(spark, d):
    ev = stats.in_days(src.canonical(spark, d), TENANT, START, START)
    return ev.where(write_shard(F.col("event_id")) == 3).select("event_id", "name")


@query(f"WITH {EV} SELECT CAST(row_number() OVER (ORDER BY occurred_at, event_id) AS INTEGER) AS place, event_id, {AT('occurred_at')} AS at FROM ev WHERE tenant_id = '{TENANT}' AND day = DATE '{START}'")
def query_day(spark, d):
    """A tenant's day in the order of time; its rows, from all shards, are the partition that is ordered."""
    ev = stats.in_days(src.canonical(spark, d), TENANT, START, START)
    return ev.select(F.row_number().over(Window.partitionBy("tenant_id", "day").orderBy("occurred_at", "event_id")).alias("place"), "event_id", instant_text(F.col("occurred_at")).alias("at"))


@query(f"WITH {EV} SELECT tenant_id, CAST(count(*) AS BIGINT) AS views, CAST(count({PAGE}) AS BIGINT) AS with_path, CAST(count(*) FILTER (json_type(properties, '$.path') <> 'VARCHAR') AS BIGINT) AS other_type FROM ev WHERE name = 'page_view' GROUP BY 1")
def json_string_filter(spark, d):
    path = json_string(F.col("properties"), "path")
    return src.canonical(spark, d).where("name = 'page_view'").groupBy("tenant_id").agg(F.count("*").alias("views"), F.count(path).alias("with_path"), F.count_if(path.isNull()).alias("other_type"))


_TEXTS = ["2024-01-05 10:30:00+02:00", "2024-01-05 09:00:00+00:00", "2024-01-05 09:30:00", "2024-02-29 23:59:59.5-01:00"]


@query("SELECT given, strftime(timezone('UTC', CAST(z AS TIMESTAMPTZ)), '%Y-%m-%d %H:%M:%S.%f') AS at, CAST(timezone('UTC', CAST(z AS TIMESTAMPTZ)) AS DATE) AS day FROM (VALUES " + ", ".join(f"('{x}', '{x if x[19:] and x[-6] in '+-' else x + '+00:00'}')" for x in _TEXTS) + ") v(given, z)")
def normalize_time(spark, d):
    src.configured(spark)
    at = normalized(F.col("given"))
    return spark.createDataFrame([(x,) for x in _TEXTS], "given string").select("given", instant_text(at).alias("at"), F.to_date(at).alias("day"))


# Idempotence and accounting


@query(f"""WITH {DV}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY batch_id) AS nth FROM dv) WHERE nth = 1 AND n >= 2000)
SELECT s.tenant_id, s.sent, CAST(coalesce(i.inserted, 0) AS BIGINT) AS inserted, CAST(s.sent - coalesce(i.inserted, 0) AS BIGINT) AS duplicates
FROM (SELECT tenant_id, CAST(count(*) AS BIGINT) AS sent FROM dv GROUP BY 1) s LEFT JOIN (SELECT tenant_id, count(*) AS inserted FROM f GROUP BY 1) i USING (tenant_id)""")
def ingest_sync(spark, d):
    """All deliveries sent to a table that already holds the first 2,000 events."""
    ev = src.canonical(spark, d)
    dv = src.deliveries(ev)
    return ingest.accepted(dv, ingest.ingest(ev.where("n < 2000"), dv, "batch_id"))


@query(f"""WITH {EV}, m AS (SELECT batch_id, n % 60 AS event, n % 100 AS pos, name, properties FROM ev)
SELECT batch_id, event, min(pos) AS pos, arg_max(name, pos) AS name, arg_max(properties, pos) AS properties FROM m GROUP BY 1, 2""")
def dedupe_message(spark, d):
    m = src.canonical(spark, d).select("batch_id", (F.col("n") % 60).alias("event"), (F.col("n") % 100).alias("pos"), "name", "properties")
    return ingest.last_in_message(m, ["batch_id"], "event", "pos").select("batch_id", "event", "pos", "name", "properties")


@query(f"WITH {DV} SELECT DISTINCT (batch_id % 1000) // 10 AS poll, batch_id % 1000 AS batch_id FROM dv")
def dedupe_poll(spark, d):
    dv = src.deliveries(src.canonical(spark, d))
    return dv.select(F.expr("(batch_id % 1000) div 10").alias("poll"), (F.col("batch_id") % 1000).alias("batch_id")).dropDuplicates(["poll", "batch_id"])


@query(f"WITH {OWNED} SELECT batch_id, tenant_id, event_id, day FROM own")
def owned_events(spark, d):
    return ingest.owned(src.deliveries(src.canonical(spark, d))).select("batch_id", "tenant_id", "event_id", "day")


@query(f"WITH {OWNED} SELECT b.batch_id, CAST(b.sent AS BIGINT) AS sent, CAST(coalesce(o.owned, 0) AS BIGINT) AS owned, CAST(b.sent - coalesce(o.owned, 0) AS BIGINT) AS duplicates FROM (SELECT batch_id, count(*) AS sent FROM dv GROUP BY 1) b LEFT JOIN (SELECT batch_id, count(*) AS owned FROM own GROUP BY 1) o USING (batch_id)")
def duplicates_by_batch(spark, d):
    dv = src.deliveries(src.canonical(spark, d))
    got = ingest.accepted(dv, ingest.owned(dv), "batch_id")
    return got.withColumnRenamed("inserted", "owned")


@query(f"WITH {DV} SELECT DISTINCT batch_id FROM dv WHERE batch_id NOT IN (SELECT DISTINCT batch_id FROM ev WHERE n < 5000)")
def ledger_new_batches(spark, d):
    ev = src.canonical(spark, d)
    return ingest.new_batches(src.deliveries(ev).select("batch_id"), ev.where("n < 5000").select("batch_id").distinct())


@query(f"WITH {EV} SELECT batch_id, max(day) AS processed FROM ev GROUP BY 1 HAVING max(day) >= DATE '2024-01-16'")
def ledger_prune(spark, d):
    ledger = src.canonical(spark, d).groupBy("batch_id").agg(F.max("day").alias("processed"))
    return ingest.pruned(ledger, F.col("processed"), F.lit("2024-01-31").cast("date"))


@query(f"WITH {OWNED} SELECT tenant_id, received_day, CAST(count(*) AS BIGINT) AS event_count FROM own GROUP BY 1, 2")
def usage_daily(spark, d):
    own = ingest.owned(src.deliveries(src.canonical(spark, d)))
    delta = own.groupBy("tenant_id", "received_day").agg(F.count("*").alias("n"))
    return ingest.usage(None, delta)


@query(f"WITH {OWNED} SELECT CAST(coalesce(count(*), 0) AS BIGINT) AS billed, CAST((SELECT count(DISTINCT batch_id) FROM dv) AS BIGINT) AS batches FROM own")
def usage_total(spark, d):
    dv = src.deliveries(src.canonical(spark, d))
    u = ingest.usage(None, ingest.owned(dv).groupBy("tenant_id", "received_day").agg(F.count("*").alias("n")))
    return u.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("billed")).crossJoin(dv.agg(F.countDistinct("batch_id").alias("batches")))


@query(f"""WITH {OWNED}, dead AS (SELECT DISTINCT batch_id FROM dv WHERE batch_id % 17 = 3)
SELECT tenant_id, CAST(count(*) AS BIGINT) AS stored, CAST(count(*) FILTER (batch_id NOT IN (SELECT batch_id FROM dead)) AS BIGINT) AS billed, CAST(count(*) FILTER (batch_id IN (SELECT batch_id FROM dead)) AS BIGINT) AS gap, CAST(count(DISTINCT event_id) AS BIGINT) AS unique_events FROM own GROUP BY 1""")
def reconcile(spark, d):
    """Stored and billed events where every seventeenth batch went to the dead letters after it was stored."""
    own = ingest.owned(src.deliveries(src.canonical(spark, d)))
    dead = F.col("batch_id") % 17 == 3
    return own.groupBy("tenant_id").agg(F.count("*").alias("stored"), F.count_if(~dead).alias("billed"), F.count_if(dead).alias("gap"), F.countDistinct("event_id").alias("unique_events"))


@query(f"WITH {EV} SELECT tenant_id, day, received_day, CAST(count(*) AS BIGINT) AS events FROM ev WHERE received_day > day GROUP BY ALL")
def late_events(spark, d):
    return src.canonical(spark, d).where("received_day > day").groupBy("tenant_id", "day", "received_day").agg(F.count("*").alias("events"))


@query(f"WITH {EV} SELECT tenant_id, day, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT distinct_id) AS BIGINT) AS users FROM ev GROUP BY ALL")
def daily_rollup(spark, d):
    return src.canonical(spark, d).groupBy("tenant_id", "day").agg(F.count("*").alias("events"), F.countDistinct("distinct_id").alias("users"))


# Validation, constraints and keys


def _wire(spark: SparkSession, d: str) -> DataFrame:
    """Wire events of requests of ten, some of them bad."""
    n = F.col("n")
    return src.canonical(spark, d).select(
        F.expr("n div 10").alias("request"), "n",
        F.when(n % 97 == 0, "nope").otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))).alias("event_id"),
        F.when(n % 89 == 0, F.repeat(F.lit("x"), 201)).otherwise(F.col("name")).alias("name"),
        F.when(n % 83 == 0, "").otherwise(F.col("distinct_id")).alias("distinct_id"),
        F.when(n % 79 == 0, "[1]").otherwise(F.col("properties")).alias("properties"),
        F.when(n % 73 == 0, "yesterday").otherwise(instant_text(F.col("occurred_at"))).alias("occurred_at"))


@query(f"""WITH {EV} SELECT n // 10 AS request, CAST(count(*) AS BIGINT) AS events, bool_and(n % 97 <> 0 AND n % 89 <> 0 AND n % 83 <> 0 AND n % 79 <> 0 AND n % 73 <> 0) AS accepted FROM ev GROUP BY 1""")
def validate_batches(spark, d):
    return validate.valid_requests(_wire(spark, d), validate.valid_event(*[F.col(c) for c in ("event_id", "name", "distinct_id", "properties", "occurred_at")]), "request")


@query(f"""WITH {EV}, r AS (SELECT n // 700 AS request, tenant_id, CAST(count(*) AS BIGINT) AS events, bool_and(n % 97 <> 0 OR n % 2 = 0) AS fine FROM ev GROUP BY 1, 2)
SELECT request, tenant_id, events, CAST(CASE WHEN tenant_id NOT IN ('t0', 't1', 't2') THEN 401 WHEN NOT fine THEN 422 WHEN events > 180 THEN 413 ELSE 202 END AS INTEGER) AS status FROM r""")
def request_outcomes(spark, d):
    """What a tenant's requests are answered: t3's key is revoked, some have a bad event, some more events than the 180 set here."""
    ev = src.canonical(spark, d)
    ev = ev.withColumn("event_id", F.when((F.col("n") % 97 == 0) & (F.col("n") % 2 != 0), "nope").otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad("event_id", 12, "0"))))
    ok = validate.valid_event(F.col("event_id"), F.col("name"), F.col("distinct_id"), F.col("properties"), instant_text(F.col("occurred_at")))
    rows = ev.groupBy(F.expr("n div 700").alias("request"), "tenant_id").agg(F.count("*").alias("events"), F.bool_and(ok).alias("fine"))
    keys = src.api_keys(spark).where("revoked_at is null").select("tenant_id", F.lit(True).alias("known"))
    rows = rows.join(F.broadcast(keys), "tenant_id", "left")  # a row for each key, five here
    return validate.outcomes(rows, F.col("known"), F.col("fine"), F.col("events"), most=180).select("request", "tenant_id", "events", "status")


@query("SELECT DISTINCT p_name || '#/ ~*+%é' || p_brand AS text, url_encode(p_name || '#/ ~*+%é' || p_brand) AS part FROM part")
def url_parts(spark, d):
    text = F.concat(F.col("p_name"), F.lit("#/ ~*+%é"), F.col("p_brand"))
    return src.table(spark, d, "part").select(text.alias("text")).distinct().withColumn("part", url_part(F.col("text")))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """A line for each batch; every ninth is cut short."""
    ev = src.canonical(spark, d)
    e = F.struct("event_id", "name", "distinct_id", "properties", instant_text(F.col("occurred_at")).alias("occurred_at"))
    rows = ev.groupBy("batch_id").agg(F.min("tenant_id").alias("tenant_id"), F.max(instant_text(F.col("occurred_at"))).alias("received_at"), F.array_sort(F.collect_list(e)).alias("events"))
    line = F.to_json(F.struct(F.col("batch_id").cast("string").alias("batch_id"), "tenant_id", "received_at", "events"))
    return rows.select("batch_id", F.when(F.col("batch_id") % 9 == 4, F.substring(line, 1, 40)).otherwise(line).alias("value"))


@query(f"WITH {EV} SELECT batch_id, batch_id % 9 = 4 AS dead, CASE WHEN batch_id % 9 = 4 THEN 0 ELSE CAST(count(*) AS BIGINT) END AS events FROM ev GROUP BY 1")
def dead_letter(spark, d):
    p = validate.parsed(_messages(spark, d))
    return p.select("batch_id", F.col("message").isNull().alias("dead"), F.coalesce(F.size("message.events"), F.lit(0)).cast("bigint").alias("events"))


@query(f"WITH {EV} SELECT event_id, CAST(length(properties) AS INTEGER) AS size FROM ev WHERE length(properties) + 1 > 15")
def oversized_events(spark, d):
    ev = src.canonical(spark, d).select("event_id", F.char_length("properties").alias("size"))
    return validate.oversized(ev, F.col("size"), 15)


_TENANT_ROWS = "(VALUES ('t0','free',10,40),('t1','pro',20,50),('t2','enterprise',30,60),('t3','gold',0,70)) t(id, plan, rate, burst)"


@query(f"""WITH t AS (SELECT * FROM {_TENANT_ROWS})
SELECT 'plan in (''free'', ''pro'', ''enterprise'')' AS "constraint", CAST(count(*) FILTER (plan NOT IN ('free','pro','enterprise')) AS BIGINT) AS violations FROM t
UNION ALL SELECT 'rate_limit_per_sec > 0', CAST(count(*) FILTER (NOT rate > 0) AS BIGINT) FROM t UNION ALL SELECT 'rate_limit_burst > 0', CAST(count(*) FILTER (NOT burst > 0) AS BIGINT) FROM t""")
def constraint_violations(spark, d):
    return validate.violations(src.tenants(spark), src.CHECKS["tenants"])


@query("""SELECT k.id, k.tenant_id FROM (VALUES ('k0','t0'),('k1','t1'),('k2','t2'),('k3','t3'),('k4','t4')) k(id, tenant_id) WHERE tenant_id NOT IN ('t0','t1','t2','t3')""")
def orphan_check(spark, d):
    return validate.orphans(src.api_keys(spark), src.tenants(spark), "tenant_id").select("id", "tenant_id")


@query(f"""WITH k AS (SELECT 't' || i AS tenant_id, sha256('tk_live_t' || i) AS h, i = 3 AS revoked FROM range(5) r(i)), p AS (SELECT DISTINCT 't' || CAST(o_custkey % 6 AS VARCHAR) AS who FROM orders)
SELECT p.who, sha256('tk_live_' || p.who) AS key_hash, substr('tk_live_' || p.who, 1, 12) AS prefix, t.plan, t.rate AS rate_limit_per_sec FROM p JOIN k ON k.h = sha256('tk_live_' || p.who) AND NOT k.revoked JOIN {_TENANT_ROWS} ON t.id = k.tenant_id""")
def auth_lookup(spark, d):
    """Presented keys, looked up by their hash; revoked and unknown ones give nothing. Both dimensions are of a fixed size here."""
    given = src.table(spark, d, "orders").select(F.concat(F.lit("t"), (F.col("o_custkey") % 6).cast("string")).alias("who")).distinct()
    given = given.withColumn("key_hash", F.sha2(F.concat(F.lit("tk_live_"), "who"), 256))
    keys = src.api_keys(spark).where("revoked_at is null").join(src.tenants(spark).withColumnRenamed("id", "tenant_id"), "tenant_id")
    return given.join(keys, "key_hash").select("who", "key_hash", F.col("key_prefix").alias("prefix"), "plan", "rate_limit_per_sec")


@query(f"WITH {EV} SELECT batch_id, unnest(list(event_id ORDER BY event_id)) AS event_id, unnest(list(name ORDER BY event_id)) AS name FROM ev GROUP BY 1")
def unnest_batch(spark, d):
    """Parallel arrays, as a statement's parameters hold them, back to rows."""
    b = src.canonical(spark, d).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "name"))).alias("x")).select("batch_id", F.col("x.event_id").alias("ids"), F.col("x.name").alias("names"))
    return b.select("batch_id", F.explode(F.arrays_zip("ids", "names")).alias("x")).select("batch_id", F.col("x.ids").alias("event_id"), F.col("x.names").alias("name"))


# Sketches


def _items(spark: SparkSession, d: str) -> DataFrame:
    return sketches.sketch_items(src.canonical(spark, d))


_stored: dict[tuple[str, str], DataFrame] = {}


def _states(spark: SparkSession, d: str) -> DataFrame:
    """The stored sketch states of the test data, partitioned by tenant and day. They are written, and their files listed, once in an application."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _stored:
        path = f"{_scratch(spark)}/states"
        rows = sketches.states(_items(spark, d))
        rows.repartition("tenant_id", "day").write.partitionBy("tenant_id", "day").parquet(path)
        _stored[at] = src.configured(spark).read.schema(sketches.STATES).parquet(path)
    return _stored[at]


@query(f"WITH {ITEMS} SELECT * FROM items")
def sketch_items(spark, d):
    return _items(spark, d)


@query(f"WITH {EV} {registers_sql('ev', 'distinct_id', 'tenant_id, day', 6).join(['SELECT * FROM (', ')'])}")
def hll_registers(spark, d):
    return sketches.hll_registers(src.canonical(spark, d), "distinct_id", ["tenant_id", "day"], 6)


@query(f"WITH {EV}, r AS ({registers_sql('ev', 'distinct_id', 'tenant_id, day', 8)}) SELECT tenant_id, idx, max(rank) AS rank FROM r WHERE day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2")
def hll_merge_range(spark, d):
    r = sketches.hll_registers(src.canonical(spark, d), "distinct_id", ["tenant_id", "day"], 8)
    return sketches.hll_merge(r.where(F.col("day").between(START, END)), ["tenant_id"])


_PS = (4, 5, 6, 8, 14)


@query(f"WITH {EV}, " + ", ".join(f"r{p} AS ({registers_sql('ev', 'distinct_id', 'tenant_id', p)}), e{p} AS ({estimate_sql(f'r{p}', 'tenant_id', p)})" for p in _PS) + " " + " UNION ALL ".join(f"SELECT {p} AS p, tenant_id, round(estimate, 6) AS estimate FROM e{p}" for p in _PS))
def hll_estimate(spark, d):
    """Estimates of several precisions, of which the small ones leave the range of linear counting."""
    ev = src.canonical(spark, d)
    each = [sketches.hll_estimate(sketches.hll_registers(ev, "distinct_id", ["tenant_id"], p), ["tenant_id"], p).select(F.lit(p).alias("p"), "tenant_id", F.round("estimate", 6).alias("estimate")) for p in _PS]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


_RANGE_USERS = f"WITH {EV}, d AS ({registers_sql('ev', 'distinct_id', 'tenant_id, day', 14)}), r AS (SELECT tenant_id, idx, max(rank) AS rank FROM d WHERE day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2), e AS ({estimate_sql('r', 'tenant_id', 14)})"


def _range_users(spark: SparkSession, d: str) -> DataFrame:
    r = sketches.hll_registers(src.canonical(spark, d), "distinct_id", ["tenant_id", "day"])
    return sketches.hll_estimate(sketches.hll_merge(r.where(F.col("day").between(START, END)), ["tenant_id"]), ["tenant_id"])


@query(f"{_RANGE_USERS} SELECT tenant_id, round(estimate, 6) AS estimate FROM e")
def unique_users_range(spark, d):
    return _range_users(spark, d).select("tenant_id", F.round("estimate", 6).alias("estimate"))


_E = 2 * hll_error(14)


@query(f"{_RANGE_USERS}, x AS (SELECT tenant_id, count(DISTINCT distinct_id) AS users FROM ev WHERE day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1) SELECT tenant_id, round(estimate * {1 - _E!r}, 5) AS low, round(estimate * {1 + _E!r}, 5) AS high, users BETWEEN estimate * {1 - _E!r} AND estimate * {1 + _E!r} AS inside FROM e JOIN x USING (tenant_id)")
def unique_users_band(spark, d):
    exact = src.canonical(spark, d).where(F.col("day").between(START, END)).groupBy("tenant_id").agg(F.countDistinct("distinct_id").alias("users"))
    return stats.band(_range_users(spark, d)).join(exact, "tenant_id").select("tenant_id", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), F.col("users").between(F.col("low"), F.col("high")).alias("inside"))


_TRIALS = 20


@query(f"""WITH t AS (SELECT DISTINCT t, CAST(t AS VARCHAR) || ':' || CAST(o_custkey AS VARCHAR) AS item FROM orders, range({_TRIALS}) x(t)), r AS ({registers_sql('t', 'item', 't', 10)}), e AS ({estimate_sql('r', 't', 10)}),
s AS (SELECT (estimate - n) / n AS err FROM e, (SELECT count(DISTINCT o_custkey) AS n FROM orders))
SELECT round(stddev_pop(err), 9) AS sigma, round(avg(err), 9) AS bias, round(avg(abs(err)), 9) AS mean_abs, CAST(count(*) AS BIGINT) AS trials FROM s""")
def hll_accuracy(spark, d):
    keys = src.table(spark, d, "orders").select("o_custkey").distinct()
    t = keys.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(_TRIALS - 1)))).withColumn("item", F.concat_ws(":", F.col("t").cast("string"), F.col("o_custkey").cast("string")))
    e = sketches.hll_estimate(sketches.hll_registers(t, "item", ["t"], 10), ["t"], 10)
    err = e.crossJoin(F.broadcast(keys.agg(F.count("*").alias("n")))).select(((F.col("estimate") - F.col("n")) / F.col("n")).alias("err"))
    return err.agg(F.round(F.stddev_pop("err"), 9).alias("sigma"), F.round(F.avg("err"), 9).alias("bias"), F.round(F.avg(F.abs("err")), 9).alias("mean_abs"), F.count("*").alias("trials"))


_SIZES = [(0.01, 0.01), (0.005, 0.01), (0.001, 0.01), (0.0005, 0.05)]


@query("SELECT epsilon, delta, CAST(ceil(exp(1.0) / epsilon) AS INTEGER) AS width, CAST(ceil(ln(1 / delta)) AS INTEGER) AS depth FROM (VALUES " + ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in _SIZES) + ") v(epsilon, delta)")
def cms_dims(spark, d):
    return spark.createDataFrame([(a, b, *cms_size(a, b)) for a, b in _SIZES], "epsilon double, delta double, width int, depth int")


_W, _D = cms_size(0.005, 0.01)
_NAMES = "items AS (SELECT tenant_id, day, name AS item, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return src.canonical(spark, d).groupBy("tenant_id", "day", F.col("name").alias("item")).agg(F.count("*").alias("n"))


@query(f"WITH {EV}, {_NAMES} {cells_sql('items', 'tenant_id', _W, _D)}")
def cms_cells(spark, d):
    return sketches.cms_cells(_names(spark, d), "item", "n", ["tenant_id"], _W, _D)


@query(f"WITH {EV}, {_NAMES}, c AS ({cells_sql('items', 'tenant_id, day', _W, _D)}) SELECT tenant_id, row, col, CAST(sum(total) AS BIGINT) AS total FROM c GROUP BY ALL")
def cms_merge(spark, d):
    return sketches.cms_merge(sketches.cms_cells(_names(spark, d), "item", "n", ["tenant_id", "day"], _W, _D), ["tenant_id"])


_PARTS = "items AS (SELECT CAST(l_partkey AS VARCHAR) AS item, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1)"
_ESTIMATES = f"""c AS ({cells_sql('items', '', 544, 5)}), q AS (SELECT item, CAST(r AS INTEGER) AS row, (CAST(CAST('0x' || substr(md5(item), 1, 8) AS UBIGINT) AS BIGINT) + r * (CAST(CAST('0x' || substr(md5(item), 9, 8) AS UBIGINT) AS BIGINT) | 1)) % 544 AS col FROM items, range(5) x(r)),
est AS (SELECT item, CAST(min(total) AS BIGINT) AS estimate FROM q JOIN c USING (row, col) GROUP BY 1)"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = src.table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("item")).agg(F.count("*").alias("n"))
    return items, sketches.cms_estimate(sketches.cms_cells(items, "item", "n", [], 544, 5), items, "item", [], 544, 5)


@query(f"WITH {_PARTS}, {_ESTIMATES} SELECT item, estimate FROM est")
def cms_estimate(spark, d):
    """Part counts from a sketch too narrow for them, so that over-counting shows."""
    return _parts(spark, d)[1].select("item", "estimate")


_BOUND = cms_bounds(544, 5)[0]


@query(f"WITH {_PARTS}, {_ESTIMATES} SELECT round(avg(estimate - n), 6) AS mean_over, CAST(max(estimate - n) AS BIGINT) AS max_over, round(avg(CASE WHEN estimate - n <= {_BOUND!r} * total THEN 1.0 ELSE 0.0 END), 6) AS within, CAST(min(estimate - n) AS BIGINT) AS min_over FROM est JOIN items USING (item), (SELECT sum(n) AS total FROM items)")
def sketch_error(spark, d):
    items, est = _parts(spark, d)
    x = est.join(items, "item").crossJoin(F.broadcast(items.agg(F.sum("n").alias("total")))).withColumn("over", F.col("estimate") - F.col("n"))
    return x.agg(F.round(F.avg("over"), 6).alias("mean_over"), F.max("over").alias("max_over"), F.round(F.avg(F.when(F.col("over") <= _BOUND * F.col("total"), 1.0).otherwise(0.0)), 6).alias("within"), F.min("over").alias("min_over"))


@query(f"WITH {ITEMS} SELECT tenant_id, day, kind, item, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, day, kind ORDER BY n DESC, item) AS rank FROM items WHERE kind <> 'users') WHERE rank <= 5")
def topk_daily(spark, d):
    return sketches.top(_items(spark, d).where("kind <> 'users'"), ["tenant_id", "day", "kind"], "item", "n", 5)


@query(f"""WITH {ITEMS}, p AS (SELECT * FROM items WHERE kind = 'pages'), cand AS (SELECT tenant_id, item FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, day ORDER BY n DESC, item) AS r FROM p) WHERE r <= 3 GROUP BY ALL),
m AS (SELECT tenant_id, item, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL), cut AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, item DESC) AS r FROM m JOIN cand USING (tenant_id, item)) WHERE r <= 5)
SELECT tenant_id, item, n, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, item) AS INTEGER) AS rank FROM cut""")
def topk_merge_range(spark, d):
    pages = _items(spark, d).where("kind = 'pages'")
    cand = sketches.top(pages, ["tenant_id", "day"], "item", "n", 3)
    return sketches.top_merge(cand, pages.groupBy("tenant_id", "item").agg(F.sum("n").alias("n")), ["tenant_id"], "item", "n", 5)


@query(f"""WITH {_PARTS}, {_ESTIMATES}, a AS (SELECT item FROM est ORDER BY estimate DESC, item LIMIT 50), b AS (SELECT item FROM items ORDER BY n DESC, item LIMIT 50)
SELECT round(count(*) / 50.0, 6) AS recall FROM a JOIN b USING (item)""")
def topk_recall(spark, d):
    items, est = _parts(spark, d)
    a, b = est.orderBy(F.desc("estimate"), "item").limit(50), items.orderBy(F.desc("n"), "item").limit(50)
    return a.select("item").intersect(b.select("item")).agg(F.round(F.count("*") / 50.0, 6).alias("recall"))


_APPROX = f"""WITH {ITEMS}, dr AS ({registers_sql('ev', 'distinct_id', 'tenant_id, day', 14)}), r AS (SELECT tenant_id, idx, max(rank) AS rank FROM dr WHERE tenant_id = '{TENANT}' AND day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2), e AS ({estimate_sql('r', 'tenant_id', 14)}),
c AS (SELECT kind, item AS key, CAST(sum(n) AS BIGINT) AS count FROM items WHERE tenant_id = '{TENANT}' AND day BETWEEN DATE '{START}' AND DATE '{END}' AND kind <> 'users' GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, key) AS rank FROM c) WHERE rank <= 10)"""


def _approximate(spark: SparkSession, d: str) -> DataFrame:
    return stats.approximate(_states(spark, d), TENANT, START, END)


def _flat(one: DataFrame) -> DataFrame:
    """The nested answer as rows."""
    lists = F.array(F.struct(F.lit("events").alias("kind"), F.col("top_events").alias("rows")), F.struct(F.lit("pages").alias("kind"), F.col("top_pages").alias("rows")))
    out = one.select("events", "unique_users", F.explode(lists).alias("x")).select("events", "unique_users", "x.kind", F.posexplode("x.rows").alias("rank", "r"))
    return out.select("events", "unique_users", "kind", (F.col("rank") + 1).alias("rank"), F.col("r.key").alias("key"), F.col("r.count").alias("count"))


@query(f"{_APPROX} SELECT (SELECT CAST(sum(count) AS BIGINT) FROM c WHERE kind = 'events') AS events, (SELECT CAST(round_even(estimate, 0) AS BIGINT) FROM e) AS unique_users, kind, CAST(rank AS INTEGER) AS rank, key, count FROM t")
def stats_approx(spark, d):
    return _flat(_approximate(spark, d))


_LISTS = """SELECT kind, list(struct_pack(key := key, count := count) ORDER BY rank) AS ranked"""


@query(f"""{_APPROX}, x AS (SELECT count(*) AS events, count(DISTINCT distinct_id) AS users FROM ev WHERE {IN_RANGE}),
raw AS (SELECT 'events' AS kind, name AS key FROM ev WHERE {IN_RANGE} UNION ALL SELECT 'pages', {PAGE} FROM ev WHERE {IN_RANGE} AND name = 'page_view' AND {PAGE} IS NOT NULL),
rc AS (SELECT kind, key, CAST(count(*) AS BIGINT) AS count FROM raw GROUP BY ALL), rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, key) AS rank FROM rc) WHERE rank <= 10),
a AS ({_LISTS} FROM t GROUP BY 1), b AS ({_LISTS} FROM rt GROUP BY 1)
SELECT (SELECT CAST(sum(count) AS BIGINT) FROM c WHERE kind = 'events') = x.events AS events_equal, abs((SELECT round_even(estimate, 0) FROM e) - x.users) <= 0.03 * x.users AS users_close,
(SELECT bool_and(a.ranked = b.ranked) AND count(*) = (SELECT count(*) FROM b) FROM a JOIN b USING (kind)) AS top_equal FROM x""")
def approx_vs_exact(spark, d):
    a, b = _approximate(spark, d), stats.stats(src.canonical(spark, d), TENANT, START, END)
    b = b.select(*[F.col(c).alias(f"x_{c}") for c in b.columns])
    return a.crossJoin(b).select((F.col("events") == F.col("x_events")).alias("events_equal"), (F.abs(F.col("unique_users") - F.col("x_unique_users")) <= 0.03 * F.col("x_unique_users")).alias("users_close"), ((F.col("top_events") == F.col("x_top_events")) & (F.col("top_pages") == F.col("x_top_pages"))).alias("top_equal"))


_SW, _SD, _SK = sketches.WIDTH, sketches.DEPTH, sketches.K
_POS = f"(CAST(CAST('0x' || substr(md5(item), 1, 8) AS UBIGINT) AS BIGINT) + r * (CAST(CAST('0x' || substr(md5(item), 9, 8) AS UBIGINT) AS BIGINT) | 1)) % {_SW}"
_TOP = f"""counted AS (SELECT * FROM items WHERE kind <> 'users'), cells AS ({cells_sql('counted', 'tenant_id, day, kind', _SW, _SD)}),
cand AS (SELECT tenant_id, day, kind, item FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, day, kind ORDER BY n DESC, item) AS nth FROM counted) WHERE nth <= {_SK}),
pool AS (SELECT DISTINCT tenant_id, kind, item FROM cand), whole AS (SELECT tenant_id, kind, row, col, sum(total) AS total FROM cells GROUP BY ALL),
est AS (SELECT p.tenant_id, p.kind, p.item, CAST(min(w.total) AS BIGINT) AS n FROM (SELECT pool.*, CAST(r AS INTEGER) AS row, {_POS} AS col FROM pool, range({_SD}) x(r)) p JOIN whole w USING (tenant_id, kind, row, col) GROUP BY ALL)"""


@query(f"WITH {ITEMS}, {_TOP}, u AS (SELECT tenant_id, day, 'users' AS kind, count(*) AS used FROM ({registers_sql('ev', 'distinct_id', 'tenant_id, day', 14)}) GROUP BY ALL UNION ALL SELECT tenant_id, day, kind, count(*) FROM cells GROUP BY ALL) "
       "SELECT tenant_id, day, kind, CAST(used AS INTEGER) AS used, CAST((SELECT sum(n) FROM items i WHERE i.tenant_id = u.tenant_id AND i.day = u.day AND i.kind = u.kind) AS BIGINT) AS total, coalesce((SELECT string_agg(item, ',' ORDER BY item) FROM cand c WHERE c.tenant_id = u.tenant_id AND c.day = u.day AND c.kind = u.kind), '') AS names FROM u")
def sketch_states(spark, d):
    """Each stored state: registers or cells in use, its total, and the names of its top-k candidates, twenty at most."""
    return _states(spark, d).select("tenant_id", "day", "kind", F.size("cells").alias("used"), "total", F.array_join("names", ",").alias("names"))


@query(f"WITH {ITEMS}, {_TOP} SELECT tenant_id, kind, item, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, kind ORDER BY n DESC, item) AS rank FROM est) WHERE rank <= 10")
def topk_sketch(spark, d):
    """Top ten of each tenant over all days: pooled candidates of the daily states, counted in their merged Count-Min cells."""
    each = sketches.estimates(_states(spark, d), ["tenant_id", "kind"]).where("kind <> 'users'")
    rows = each.select("tenant_id", "kind", F.posexplode(F.slice("ranked", 1, 10)).alias("rank", "x"))
    return rows.select("tenant_id", "kind", F.col("x.item").alias("item"), F.col("x.n").alias("n"), (F.col("rank") + 1).alias("rank"))


@query(f"""WITH {_PARTS}, c AS ({cells_sql('items', '', _SW, _SD)}), q AS (SELECT item, CAST(r AS INTEGER) AS row, {_POS} AS col FROM items, range({_SD}) x(r)),
est AS (SELECT item, CAST(min(total) AS BIGINT) AS estimate FROM q JOIN c USING (row, col) GROUP BY 1),
a AS (SELECT item, row_number() OVER (ORDER BY estimate DESC, item) AS rank FROM est), b AS (SELECT item, n, row_number() OVER (ORDER BY n DESC, item) AS rank FROM items)
SELECT CAST(b.rank AS INTEGER) AS rank, b.item, b.n, a.item AS found, a.item = b.item AS same FROM a JOIN b USING (rank) WHERE rank <= 10""")
def topk_order(spark, d):
    """The ten largest parts, exactly and by the engine's sketch, place by place."""
    items = src.table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("item")).agg(F.count("*").alias("n"))
    est = sketches.cms_estimate(sketches.cms_cells(items, "item", "n", [], _SW, _SD), items, "item", [], _SW, _SD)
    a = sketches.top(est.withColumn("k", F.lit(0)), ["k"], "item", "estimate", 10).select("rank", F.col("item").alias("found"))
    b = sketches.top(items.withColumn("k", F.lit(0)), ["k"], "item", "n", 10).select("rank", "item", "n")
    return b.join(a, "rank").select("rank", "item", "n", "found", (F.col("found") == F.col("item")).alias("same"))


_STATE = "state AS (SELECT tenant_id, day, kind, CAST(sum(CASE WHEN kind = 'pages' AND day = DATE '2024-01-07' THEN NULL ELSE n END) AS BIGINT) AS data FROM items GROUP BY 1, 2, 3)"


def _state(spark: SparkSession, d: str) -> DataFrame:
    """Sketch rows of which one day's pages are only placeholders."""
    blank = (F.col("kind") == "pages") & (F.col("day") == F.lit("2024-01-07").cast("date"))
    return _items(spark, d).groupBy("tenant_id", "day", "kind").agg(F.sum("n").alias("data")).withColumn("data", F.when(~blank, F.col("data")))


@query(f"WITH {ITEMS}, {_STATE} SELECT kind, data FROM state WHERE tenant_id = '{TENANT}' AND day BETWEEN DATE '{START}' AND DATE '{END}' AND data IS NOT NULL")
def sketch_scan(spark, d):
    return stats.in_days(_state(spark, d), TENANT, START, END).where("data is not null").select("kind", "data")


@query(f"WITH {ITEMS}, {_STATE} SELECT s.* FROM state s JOIN (SELECT DISTINCT tenant_id, day, 'pages' AS kind FROM ev WHERE n < 700) USING (tenant_id, day, kind)")
def sketch_touch(spark, d):
    keys = src.canonical(spark, d).where("n < 700").select("tenant_id", "day", F.lit("pages").alias("kind")).distinct()
    return _state(spark, d).join(keys, ["tenant_id", "day", "kind"])


@query(f"WITH {ITEMS}, {_TOP}, u AS (SELECT tenant_id, day, 'users' AS kind, count(*) AS used, max(rank) AS largest FROM ({registers_sql('ev', 'distinct_id', 'tenant_id, day', 14)}) GROUP BY ALL UNION ALL SELECT tenant_id, day, kind, count(*), max(total) FROM cells GROUP BY ALL) "
       "SELECT tenant_id, day, kind, CAST(used AS INTEGER) AS used, CAST(largest AS BIGINT) AS largest, CAST((SELECT sum(n) FROM items i WHERE i.tenant_id = u.tenant_id AND i.day = u.day AND i.kind = u.kind) AS BIGINT) AS total FROM u")
def sketch_upsert(spark, d):
    """Stored states with those of new events merged in and written back; a key without a state begins with an empty one."""
    ev = src.canonical(spark, d)
    path = f"{_scratch(spark)}/upsert"
    for part in (ev.where("n < 4000"), ev.where("n >= 4000")):
        new = sketches.states(sketches.sketch_items(part))
        new.write.mode("append").partitionBy("day").parquet(f"{path}/deltas")
    sketches.merged(spark.read.schema(sketches.STATES).parquet(f"{path}/deltas")).write.partitionBy("day").parquet(f"{path}/merged")
    rows = spark.read.schema(sketches.STATES).parquet(f"{path}/merged")
    return rows.select("tenant_id", "day", "kind", F.size("cells").alias("used"), F.array_max(F.transform("cells", lambda c: c["v"])).alias("largest"), "total")


# Routing, chunks and limits

_NODES = ["q-0", "q-1", "q-2", "q-3"]


def _ring_sql(name: str, nodes: list[str]) -> str:
    return f"{name} AS (SELECT substr(md5(node || '#' || CAST(v AS VARCHAR)), 1, 16) AS pos, node FROM (VALUES {', '.join(f"('{n}')" for n in nodes)}) t(node), range(160) x(v))"


def _route_sql(ring: str) -> str:
    return f"coalesce((SELECT arg_min(node, pos) FROM {ring} WHERE pos > substr(md5(k.key), 1, 16)), (SELECT arg_min(node, pos) FROM {ring}))"


_KEYS = "k AS (SELECT DISTINCT 'tenant-' || CAST(o_custkey AS VARCHAR) AS key FROM orders)"


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "orders").select(F.concat(F.lit("tenant-"), F.col("o_custkey").cast("string")).alias("key")).distinct()


@query(f"WITH {_KEYS}, {_ring_sql('ring', _NODES)} SELECT key, {_route_sql('ring')} AS node FROM k")
def route_tenants(spark, d):
    return routing.route(_keys(spark, d), "key", routing.ring(spark, _NODES))


@query(f"WITH {_KEYS}, {_ring_sql('a', _NODES)}, {_ring_sql('b', [*_NODES, 'q-4'])}, r AS (SELECT {_route_sql('a')} AS before, {_route_sql('b')} AS after FROM k) SELECT before, after, CAST(count(*) AS BIGINT) AS keys FROM r GROUP BY 1, 2")
def ring_rebalance(spark, d):
    """Where keys go when a node joins: they stay, or go to the new node."""
    a = routing.route(_keys(spark, d), "key", routing.ring(spark, _NODES)).withColumnRenamed("node", "before")
    return routing.route(a, "key", routing.ring(spark, [*_NODES, "q-4"])).groupBy("before", F.col("node").alias("after")).agg(F.count("*").alias("keys"))


def _greedy_sql(source: str, limit: int, entries: int | None) -> str:
    full = f"g.size + s.size > {limit}" + (f" OR g.entries = {entries}" if entries else "")
    return f"""s AS (SELECT key, pos, size, row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM {source}),
g AS (SELECT key, pos, i, size, 1 AS entries, 0 AS bin FROM s WHERE i = 1 UNION ALL
  SELECT s.key, s.pos, s.i, CASE WHEN {full} THEN s.size ELSE g.size + s.size END, CASE WHEN {full} THEN 1 ELSE g.entries + 1 END, CASE WHEN {full} THEN g.bin + 1 ELSE g.bin END FROM g JOIN s ON s.key = g.key AND s.i = g.i + 1)"""


@query(f"WITH RECURSIVE {EV}, src AS (SELECT batch_id AS key, n AS pos, length(properties) + 1 AS size FROM ev), {_greedy_sql('src', 200, None)} SELECT key AS batch_id, pos AS n, CAST(bin AS INTEGER) AS bin FROM g")
def chunk_events(spark, d):
    rows = src.canonical(spark, d).select("batch_id", "n", (F.char_length("properties") + 1).alias("size"))
    return routing.greedy(rows, ["batch_id"], "n", "size", 200).select("batch_id", "n", "bin")


@query(f"WITH RECURSIVE {EV}, src AS (SELECT batch_id AS key, n AS pos, strlen(properties) AS size FROM ev), {_greedy_sql('src', 250, 10)} SELECT key AS batch_id, pos AS n, CAST(bin AS INTEGER) AS bin FROM g")
def pack_bodies(spark, d):
    rows = src.canonical(spark, d).select("batch_id", "n", F.octet_length("properties").alias("size"))
    return routing.greedy(rows, ["batch_id"], "n", "size", 250, 10).select("batch_id", "n", "bin")


@query(f"WITH RECURSIVE {EV}, src AS (SELECT tenant_id || '/' || CAST(batch_id AS VARCHAR) AS key, n AS pos, length(properties) + 1 AS size FROM ev), {_greedy_sql('src', 200, None)}, {_ring_sql('ring', _NODES)}, k AS (SELECT key AS whole, split_part(key, '/', 1) AS key, bin, CAST(count(*) AS BIGINT) AS events, CAST(sum(s.size) AS BIGINT) AS size FROM g JOIN s USING (key, i) GROUP BY ALL) SELECT sha256(whole || '#' || CAST(bin AS VARCHAR)) AS batch_id, key AS tenant_id, {_route_sql('ring')} AS shard, events, size FROM k")
def enqueue_plan(spark, d):
    """The messages of each request: chunk, the tenant's shard, and a batch id made from the content, so that a replay makes the same."""
    rows = src.canonical(spark, d).select("tenant_id", "batch_id", "n", (F.char_length("properties") + 1).alias("size"))
    chunks = routing.greedy(rows, ["tenant_id", "batch_id"], "n", "size", 200).groupBy("tenant_id", "batch_id", "bin").agg(F.count("*").alias("events"), F.sum("size").cast("bigint").alias("size"))
    key = F.concat(F.col("tenant_id"), F.lit("/"), F.col("batch_id").cast("string"), F.lit("#"), F.col("bin").cast("string"))
    routed = routing.route(chunks.withColumn("id", F.sha2(key, 256)), "tenant_id", routing.ring(spark, _NODES))
    return routed.select(F.col("id").alias("batch_id"), "tenant_id", F.col("node").alias("shard"), "events", "size")


_REQUESTS = EV + """, req AS (SELECT tenant_id, batch_id, CAST(count(*) AS BIGINT) AS cost, epoch_us(min(occurred_at)) // 1000 AS at_ms FROM ev GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY at_ms, batch_id) AS i FROM req)"""
_REFILL = "least(30.0, b.left_over + greatest(0, q.at_ms - b.at_ms) * CAST(0.001 AS DOUBLE) / 1000)"


@query(f"""WITH RECURSIVE {_REQUESTS}, b AS (
  SELECT tenant_id, batch_id, i, at_ms, cost, CAST(30.0 AS DOUBLE) AS tokens, CAST(CASE WHEN cost <= 30 THEN 30.0 - cost ELSE 30.0 END AS DOUBLE) AS left_over FROM q WHERE i = 1 UNION ALL
  SELECT q.tenant_id, q.batch_id, q.i, q.at_ms, q.cost, CAST({_REFILL} AS DOUBLE), CAST(CASE WHEN q.cost <= {_REFILL} THEN {_REFILL} - q.cost ELSE {_REFILL} END AS DOUBLE) FROM b JOIN q ON q.tenant_id = b.tenant_id AND q.i = b.i + 1)
SELECT tenant_id, batch_id AS request, cost <= tokens AS allowed, CAST(CASE WHEN cost <= tokens THEN 0 WHEN cost > 30 THEN -1 ELSE ceil((cost - tokens) * 1000 / CAST(0.001 AS DOUBLE)) END AS BIGINT) AS retry_after_ms FROM b""")
def token_bucket(spark, d):
    req = src.canonical(spark, d).groupBy("tenant_id", F.col("batch_id").alias("request")).agg(F.count("*").alias("cost"), F.min("occurred_at").alias("at"))
    req = req.withColumn("at_ms", F.unix_millis(F.col("at").cast("timestamp"))).withColumn("rate", F.lit(0.001)).withColumn("burst", F.lit(30))
    return routing.token_bucket(req, ["at_ms", "request"])


# Metrics


@query(f"WITH {EV} SELECT tenant_id, strftime(date_trunc('day', occurred_at), '%Y-%m-%d %H:%M:%S.%f') AS start, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM ev GROUP BY 1, 2")
def metric_windows(spark, d):
    w = metrics.windows(src.canonical(spark, d), "occurred_at", "value", "1 day", ["tenant_id"])
    return w.select("tenant_id", instant_text(F.col("start")).alias("start"), "n", F.round("total", 4).alias("total"), "least", "most", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p99")])


@query(f"WITH {EV}, w AS (SELECT *, unnest([60, 300]) AS seconds FROM ev) SELECT CAST(seconds AS INTEGER) AS seconds, strftime(time_bucket(to_seconds(seconds), occurred_at), '%Y-%m-%d %H:%M:%S.%f') AS start, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2")
def metric_windows_short(spark, d):
    """Windows of one and of five minutes, as monitors use them."""
    ev = src.canonical(spark, d)
    each = [metrics.windows(ev, "occurred_at", "value", f"{n} seconds", []).select(F.lit(n).alias("seconds"), instant_text(F.col("start")).alias("start"), "n", F.round("total", 4).alias("total"), "least", "most", F.round("mean", 6).alias("mean")) for n in (60, 300)]
    return each[0].union(each[1])


@query(f"WITH {EV} SELECT tenant_id, CAST(count(*) FILTER (name = 'error') AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS requests, 100.0::DOUBLE * count(*) FILTER (name = 'error') / greatest(count(*), 1) AS error_rate FROM ev GROUP BY 1")
def error_rate(spark, d):
    return metrics.rate(src.canonical(spark, d), F.col("name") == "error", ["tenant_id"])


@query(f"""WITH {EV}, c AS (SELECT tenant_id, date_trunc('hour', occurred_at) AS period, count(*) AS n FROM ev WHERE name = 'error' GROUP BY 1, 2),
full_c AS (SELECT t.tenant_id, p.period, coalesce(c.n >= 2, false) AS breach FROM (SELECT DISTINCT tenant_id FROM c) t, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS period) p LEFT JOIN c ON c.tenant_id = t.tenant_id AND c.period = p.period)
SELECT tenant_id, {AT('period')} AS period, breach, bool_and(breach) OVER w AND count(*) OVER w = 3 AS alarm FROM full_c WINDOW w AS (PARTITION BY tenant_id ORDER BY period ROWS 2 PRECEDING)""")
def alarm_state(spark, d):
    ev = src.canonical(spark, d).where("name = 'error'")
    counts = ev.groupBy("tenant_id", F.date_trunc("hour", "occurred_at").alias("period")).agg(F.count("*").alias("n"))
    a = metrics.alarms(counts, ["tenant_id"], "period", "n", F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.lit("2024-01-30 23:00:00")), "1 hour", 2, 3)
    return a.select("tenant_id", instant_text(F.col("period")).alias("period"), "breach", "alarm")


@query(f"""WITH {OWNED}, m AS (SELECT batch_id, batch_id >= 1000 AS retried, batch_id < 20 AS applied FROM dv GROUP BY 1), o AS (SELECT batch_id, count(*) AS n FROM own GROUP BY 1)
SELECT (batch_id % 1000) // 10 AS poll, CAST(count(*) AS BIGINT) AS committed, CAST(count(*) FILTER (retried) AS BIGINT) AS retried, CAST(count(*) FILTER (applied) AS BIGINT) AS already_applied, CAST(coalesce(sum(CASE WHEN NOT applied THEN coalesce(n, 0) END), 0) AS BIGINT) AS billed FROM m LEFT JOIN o USING (batch_id) GROUP BY 1""")
def batch_metrics(spark, d):
    """What each commit of ten batches reports, where the ledger already holds the first twenty batches."""
    dv = src.deliveries(src.canonical(spark, d))
    own = ingest.owned(dv).groupBy("batch_id").agg(F.count("*").alias("n"))
    m = dv.groupBy("batch_id").agg(F.count("*").alias("sent")).join(own, "batch_id", "left").withColumn("applied", F.col("batch_id") < 20)
    return m.groupBy(F.expr("(batch_id % 1000) div 10").alias("poll")).agg(F.count("*").alias("committed"), F.count_if(F.col("batch_id") >= 1000).alias("retried"), F.count_if("applied").alias("already_applied"), F.coalesce(F.sum(F.when(~F.col("applied"), F.coalesce("n", F.lit(0)))), F.lit(0)).alias("billed"))


# Without SQL: streams, byte-level states, order-dependent updates


def _log(batches: DataFrame) -> DataFrame:
    """A log line for each batch of a worker."""
    return batches.select(F.concat(F.lit("committed 10 message(s) ("), (F.col("batch_id") % 3).cast("string"), F.lit(" retried deliveries, "), (F.col("batch_id") % 2).cast("string"), F.lit(" already applied), 5 events billed"), F.when(F.col("batch_id") % 5 == 0, "; commit failed").otherwise(" (will retry)")).alias("value"))


@query(f"WITH {EV}, b AS (SELECT DISTINCT batch_id FROM ev) SELECT CAST(sum(batch_id % 3) AS BIGINT) AS retried_deliveries, CAST(sum(batch_id % 2) AS BIGINT) AS already_applied, CAST(count(*) FILTER (batch_id % 5 = 0) AS BIGINT) AS commit_failures, CAST(count(*) FILTER (batch_id % 5 <> 0) AS BIGINT) AS write_failures FROM b")
def log_counters(spark, d):
    return metrics.log_counters(_log(src.canonical(spark, d).select("batch_id").distinct()))


@query()
def hash64_udf(spark, d):
    return codecs.hashed(src.canonical(spark, d).select("distinct_id").distinct(), "distinct_id")


@query()
def sketch_roundtrip(spark, d):
    """Each day's encoded users (HyperLogLog) and event names (Count-Min, top 5), decoded again: parameters, names, registers or cells in use and the largest of them."""
    keys = ["tenant_id", "day"]
    users = codecs.hll_states(src.canonical(spark, d), keys, "distinct_id", 10)
    names = codecs.counted_states(_names(spark, d), keys, "item", "n", _W, _D, 5)
    return codecs.decoded(users.union(names.select(*keys, F.explode(F.array("cms", "top")))), keys, "data")


@query()
def cms_conservative(spark, d):
    return codecs.conservative_cells(_names(spark, d), ["tenant_id"], "item", "n", _W, _D)


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that the driver and the executors share."""
    return f"{shared_folder(spark)}/queries-{spark._jvm.java.util.UUID.randomUUID()}"


def _stream(spark: SparkSession, d: str, crash_at: str | None) -> tuple[str, str]:
    root = _scratch(spark)
    lines = _messages(spark, d)
    lines.select("value").union(lines.where("batch_id % 7 = 0").select("value")).repartition(6).write.text(f"{root}/landing")
    left = [2 if crash_at else 0]

    def fail(at: str) -> None:
        if at == crash_at and left[0]:
            left[0] -= 1
            raise RuntimeError(f"crash after {at}")

    for _ in range(3):
        q = pipeline.start(spark, f"{root}/landing", f"{root}/tables", f"{root}/checkpoint", per_trigger=3, fail=fail)
        try:
            q.awaitTermination()
            break
        except Exception:  # noqa: BLE001  a crash; the query starts again from its checkpoint
            if not left[0] and crash_at is None:
                raise
    return root, f"{root}/tables"


_LIVE = f"""{EV}, m AS (SELECT batch_id, min(tenant_id) AS tenant_id, CAST(max(occurred_at) AS DATE) AS received_day FROM ev WHERE batch_id % 9 <> 4 GROUP BY 1),
live AS (SELECT ev.* EXCLUDE (tenant_id, received_day), m.tenant_id, m.received_day FROM ev JOIN m USING (batch_id))"""


@query(f"WITH {_LIVE} SELECT tenant_id, received_day, CAST(count(*) AS BIGINT) AS event_count FROM live GROUP BY 1, 2")
def pipeline_stream(spark, d):
    """Billed usage after all messages, a seventh of them twice, ran through the stream."""
    return pipeline.usage(spark, _stream(spark, d, None)[1])


@query(f"WITH {_LIVE} SELECT CAST(count(*) AS BIGINT) AS stored, CAST(count(DISTINCT (tenant_id, event_id, occurred_at)) AS BIGINT) AS unique_events, CAST(count(*) AS BIGINT) AS billed FROM live")
def exactly_once_replay(spark, d):
    """Stored, distinct and billed events after a run that crashed twice between writing and publishing."""
    root = _stream(spark, d, "written")[1]
    stored = pipeline.read(spark, root, "events").agg(F.count("*").alias("stored"), F.countDistinct("tenant_id", "event_id", "occurred_at").alias("unique_events"))
    return stored.crossJoin(pipeline.read(spark, root, "usage").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("billed")))


@query(f"""WITH {_LIVE}, pages AS (SELECT tenant_id, {PAGE} AS page, count(*) AS n FROM live WHERE name = 'page_view' AND {PAGE} IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, page) AS nth FROM pages) WHERE nth <= 10),
r AS ({registers_sql('live', 'distinct_id', 'tenant_id', 14)}), e AS ({estimate_sql('r', 'tenant_id', 14)}), t AS (SELECT tenant_id, CAST(count(*) AS BIGINT) AS events, count(DISTINCT distinct_id) AS users FROM live GROUP BY 1)
SELECT t.tenant_id, t.events AS sent, t.events AS stored, t.events AS billed, t.events AS in_sketch, CAST((SELECT sum(n) FROM pages WHERE pages.tenant_id = t.tenant_id) AS BIGINT) AS pages_in_sketch,
abs(e.estimate - t.users) <= 0.02 * t.users AS users_close, (SELECT string_agg(page, ',' ORDER BY nth) FROM best WHERE best.tenant_id = t.tenant_id) AS top_pages, CAST(0 AS BIGINT) AS waiting FROM t JOIN e USING (tenant_id)""")
def chaos_invariants(spark, d):
    """What must agree by tenant after a run that crashed: events sent, stored, billed and in sketches, users within 2 %, the ten top pages in order; and lines still waiting."""
    root = _stream(spark, d, "stored")[1]
    pipeline.redeliver(spark, root)
    pipeline.compact(spark, root)
    sent = validate.parsed(_messages(spark, d)).where("message is not null").select("message.tenant_id", F.explode("message.events").alias("e"))
    sent = sent.groupBy("tenant_id").agg(F.countDistinct("e.event_id").alias("sent"), F.countDistinct("e.distinct_id").alias("exact"))
    stored = pipeline.read(spark, root, "events").groupBy("tenant_id").agg(F.count("*").alias("stored"))
    billed = pipeline.read(spark, root, "usage").groupBy("tenant_id").agg(F.sum("n").alias("billed"))
    each = sketches.estimates(pipeline.states(spark, root), ["tenant_id", "kind"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    best = F.concat_ws(",", F.transform(F.slice("ranked", 1, 10), lambda x: x["item"]))
    each = each.groupBy("tenant_id").agg(of("events", F.col("total")).alias("in_sketch"), of("pages", F.col("total")).alias("pages_in_sketch"), of("users", F.col("users")).alias("users"), of("pages", best).alias("top_pages"))
    last = pipeline._pending(spark, root, "main").count()
    out = sent.join(stored, "tenant_id", "left").join(billed, "tenant_id", "left").join(each, "tenant_id", "left")
    return out.select("tenant_id", "sent", "stored", "billed", "in_sketch", "pages_in_sketch", (F.abs(F.col("users") - F.col("exact")) <= 0.02 * F.col("exact")).alias("users_close"), "top_pages", F.lit(last).cast("bigint").alias("waiting"))
