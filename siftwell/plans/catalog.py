"""The engine's queries over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import findings, graph, intervals, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = 3_600_000, 86_400_000  # milliseconds
#: Byte patterns that the text queries look for.
SIGNATURES = (("at_sign", "@"), ("license", "License"), ("of_the", "of the"), ("und_d", "und d"), ("de_la", "de la"))
#: A small dictionary for the word runs.
DICTIONARY = ("the", "of", "and", "to", "in", "is", "on", "for", "with", "it", "de", "la", "le", "et", "und", "der", "die", "que", "y", "el")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def days(c: str) -> Column:
    return F.unix_date(F.col(c).cast("date")).cast("long")


def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of a user's time: an event lasts ``value`` minutes."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", millis("ts").alias("start"), (millis("ts") + F.floor(F.col("value") * 60_000)).alias("end"))


EVENT_HITS = "hits AS (SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000) AS start, (epoch_us(ts) // 1000) + floor(value * 60000)::BIGINT AS end_ FROM events)"


# --- islands and other sequences ---------------------------------------------------------------


@query(f"""
WITH h AS (SELECT DISTINCT user_id, (epoch_us(ts) // 1000) AS start, (epoch_us(ts) // 1000) + 1 AS end_, event_type FROM events),
f AS (SELECT *, CASE WHEN start - lag(start) OVER w > {6 * HOUR} THEN 1 ELSE 0 END AS cut FROM h WINDOW w AS (PARTITION BY user_id ORDER BY start, end_, event_type)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY start, end_, event_type ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, island::BIGINT AS island, count(*) AS hits, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS hit_types,
       greatest(0, min(start) - {HOUR})::BIGINT AS start, (max(end_) + {HOUR})::BIGINT AS "end" FROM i GROUP BY user_id, island""")
def events_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a user's events, each within six hours of the start of the one before."""
    hits = read(spark, sf_dir, "events").select("user_id", millis("ts").alias("start"), (millis("ts") + 1).alias("end"), F.col("event_type").alias("hit_type"))
    spots = intervals.hotspots(hits, ["user_id"], 6 * HOUR, HOUR, F.lit(0).cast("long"), F.lit(1 << 62), 7 * DAY)
    return spots.select("user_id", "island", "hits", F.array_join("hit_types", ",").alias("hit_types"), "start", "end")


def _islands_sql(cut: str) -> str:
    return f"""
WITH {EVENT_HITS},
f AS (SELECT *, CASE WHEN {cut} THEN 1 ELSE 0 END AS cut FROM (
    SELECT *, max(end_) OVER (PARTITION BY user_id ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM hits)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, island::BIGINT AS island, count(*) AS members, min(start) AS first_start, max(end_) AS last_end FROM i GROUP BY user_id, island"""


def _members(found: DataFrame) -> DataFrame:
    return found.groupBy("user_id", "island").agg(F.count("*").alias("members"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query(_islands_sql(f"start - top > {HOUR}"))
def events_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a user's time that no more than an hour after all ends so far parts."""
    return _members(intervals.islands(event_hits(spark, sf_dir), ["user_id"], HOUR, "end", 7 * DAY))


@query(_islands_sql("start >= top"))
def events_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a user's overlapping events."""
    return _members(intervals.islands(event_hits(spark, sf_dir), ["user_id"], 0, "component", 7 * DAY))


@query(f"""
WITH c AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, count(*) OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN CURRENT ROW AND {7 * DAY} FOLLOWING)),
b AS (SELECT user_id, max(n) AS n, min(total) AS total, arg_min(t, (-n, t)) AS start FROM c GROUP BY user_id)
SELECT user_id, n AS cluster, total, CASE WHEN 2 * n > total THEN start END AS start,
       CASE WHEN 2 * n <= total THEN 'none' WHEN total = 1 THEN 'medium' WHEN n >= 0.8 * total THEN 'high' ELSE 'medium' END AS confidence FROM b""")
def events_time_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven days that hold most of a user's events, the earliest of equals, if they hold the majority."""
    week = Window.partitionBy("user_id").orderBy("t").rangeBetween(0, 7 * DAY)
    e = read(spark, sf_dir, "events").select("user_id", millis("ts").alias("t")).withColumn("n", F.count("*").over(week))
    b = e.groupBy("user_id").agg(F.max("n").alias("cluster"), F.count("*").alias("total"), F.min_by("t", F.struct(-F.col("n"), F.col("t"))).alias("start"))
    none = 2 * F.col("cluster") <= F.col("total")
    confidence = F.when(none, "none").when(F.col("total") == 1, "medium").when(F.col("cluster") >= 0.8 * F.col("total"), "high").otherwise("medium")
    return b.withColumns({"start": F.when(~none, F.col("start")), "confidence": confidence})


@query(f"""
WITH {EVENT_HITS}, n AS (SELECT *, lag(end_) OVER w AS before, max(end_) OVER (PARTITION BY user_id ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
    FROM hits WINDOW w AS (PARTITION BY user_id ORDER BY start, end_))
SELECT user_id, count(*) AS units, count(*) FILTER (start > top) AS gaps, count(*) FILTER (start < top) AS overlaps, min(start) AS low, max(end_) AS high,
       count(*) FILTER (start > top) = 0 AND count(*) FILTER (start < top) = 0 AND min(start) = 1704067200000 AND max(end_) = 1706659200000 AS complete FROM n GROUP BY user_id""")
def events_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's events cover January 2024 (30 days) without gap or overlap."""
    low, high = F.lit(1704067200000), F.lit(1706659200000)
    return intervals.coverage(event_hits(spark, sf_dir), ["user_id"], low, high, 7 * DAY)


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000) AS t FROM events)
SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {HOUR} PRECEDING AND {HOUR} FOLLOWING) - 1)::BIGINT AS near FROM e""")
def events_local_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other events of the user within an hour of each."""
    around = Window.partitionBy("user_id").orderBy("t").rangeBetween(-HOUR, HOUR)
    return read(spark, sf_dir, "events").select("event_id", "user_id", millis("ts").alias("t")).select("event_id", (F.count("*").over(around) - 1).alias("near"))


@query("""
WITH s AS (SELECT DISTINCT user_id, (epoch_us(ts) // 1000) // 1000 AS t FROM events),
d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS delta FROM s),
l AS (SELECT user_id, list_sort(list(delta)) AS deltas FROM d WHERE delta IS NOT NULL GROUP BY user_id)
SELECT user_id, len(deltas)::BIGINT AS steps, deltas[len(deltas) // 2 + 1] AS median,
       len(deltas) >= 2 AND len(list_filter(deltas, lambda x: x <= 2 * deltas[len(deltas) // 2 + 1])) >= 0.8 * len(deltas) AS regular FROM l""")
def events_regular_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's events come at regular steps: four fifths within twice the upper median."""
    s = read(spark, sf_dir, "events").select("user_id", F.floor(millis("ts") / 1000).alias("t")).distinct()
    d = s.select("user_id", (F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t"))).alias("delta")).where("delta IS NOT NULL")
    # ranks instead of a list of all steps: a user's rows are sorted and may spill, no row grows with them
    own = Window.partitionBy("user_id")
    d = d.withColumns({"at": F.row_number().over(own.orderBy("delta")), "n": F.count("*").over(own)})
    d = d.withColumn("median", F.max(F.when(F.col("at") == F.floor(F.col("n") / 2) + 1, F.col("delta"))).over(own))
    g = d.groupBy("user_id").agg(F.count("*").alias("steps"), F.max("median").alias("median"), F.count_if(F.col("delta") <= 2 * F.col("median")).alias("near"))
    return g.select("user_id", "steps", "median", ((F.col("steps") >= 2) & (F.col("near") >= 0.8 * F.col("steps"))).alias("regular"))


@query("""
WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 8 ELSE 16 END AS reason FROM events)
SELECT user_id, min((epoch_us(ts) // 1000)) AS first_seen, max((epoch_us(ts) // 1000)) AS last_seen, count(*) AS events, bit_or(reason)::BIGINT AS reasons,
       arg_max(event_type, ((epoch_us(ts) // 1000), event_id)) AS last_type,
       CASE WHEN arg_max(event_type, ((epoch_us(ts) // 1000), event_id)) = 'purchase' THEN 'active' WHEN bit_or(reason) & 16 <> 0 THEN 'failed' WHEN bit_or(reason) & 4 <> 0 THEN 'known' ELSE 'unknown' END AS state
FROM e GROUP BY user_id""")
def events_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last event, count, reasons as a mask, the last type and the state that follows, for each user."""
    e = read(spark, sf_dir, "events").withColumn("t", millis("ts"))
    kinds = {"view": 1, "click": 2, "signup": 4, "purchase": 8}
    reason = F.lit(16)
    for k, v in kinds.items():
        reason = F.when(F.col("event_type") == k, v).otherwise(reason)
    g = e.groupBy("user_id").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("events"), F.bit_or(reason).cast("long").alias("reasons"), F.max_by("event_type", F.struct("t", "event_id")).alias("last_type"))
    state = F.when(F.col("last_type") == "purchase", "active").when(F.col("reasons").bitwiseAND(16) != 0, "failed").when(F.col("reasons").bitwiseAND(4) != 0, "known").otherwise("unknown")
    return g.withColumn("state", state)


@query(f"""
WITH RECURSIVE {EVENT_HITS},
o AS (SELECT user_id, start, end_, row_number() OVER (PARTITION BY user_id ORDER BY start, end_) AS k FROM hits),
m AS (SELECT user_id, k, start AS s, end_ AS e, 1 AS g FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.k, CASE WHEN o.start <= m.e AND greatest(m.e, o.end_) - m.s <= {8 * HOUR} THEN m.s ELSE o.start END,
             CASE WHEN o.start <= m.e AND greatest(m.e, o.end_) - m.s <= {8 * HOUR} THEN greatest(m.e, o.end_) ELSE o.end_ END,
             CASE WHEN o.start <= m.e AND greatest(m.e, o.end_) - m.s <= {8 * HOUR} THEN m.g ELSE m.g + 1 END
      FROM m JOIN o ON o.user_id = m.user_id AND o.k = m.k + 1)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS parts FROM m GROUP BY user_id, g""")
def events_merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's touching events merged into windows of at most eight hours."""
    return intervals.merged(event_hits(spark, sf_dir).select("user_id", "start", "end"), ["user_id"], 8 * HOUR, 7 * DAY)


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, n AS length, (sum(n) OVER w - n)::BIGINT AS logical_start, sum(n) OVER w::BIGINT AS logical_end
FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, n ROWS UNBOUNDED PRECEDING)""".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"))
def lineitem_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as runs laid end to end: where each starts and ends."""
    r = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("length"))
    upto = F.sum("length").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "length").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("logical_end", upto).withColumn("logical_start", F.col("logical_end") - F.col("length"))


# --- joins on intervals --------------------------------------------------------------------------


def _order_spans(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("id"), days("o_orderdate").alias("start"), (days("o_orderdate") + length).alias("end"))


@query("""
WITH s AS (SELECT o_custkey AS line, o_orderkey AS id, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 30 AS e FROM orders)
SELECT a.line, a.id, b.id AS other, CASE WHEN a.s = b.s AND a.e = b.e THEN 0 WHEN b.s <= a.s AND a.e <= b.e THEN 1 ELSE 2 END AS relation,
       (least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS shared
FROM s a JOIN s b ON a.line = b.line AND a.s < b.e AND b.s < a.e AND a.id < b.id""")
def orders_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders whose thirty days overlap, and how."""
    spans = _order_spans(spark, sf_dir, 30)
    both = intervals.overlapping(spans, spans, ["line"], 64, F.col("a.id") < F.col("b.id"))
    return both.select("a.line", "a.id", F.col("b.id").alias("other"), intervals.relation().alias("relation"), (F.least("a.end", "b.end") - F.greatest("a.start", "b.start")).alias("shared"))


@query("""
WITH s AS (SELECT o_custkey AS line, o_orderkey AS id, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 30 AS e FROM orders),
p AS (SELECT l_orderkey, l_linenumber, o_custkey AS line, epoch(l_shipdate)::BIGINT // 86400 AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.line = p.line AND s.s <= p.s AND p.s + 1 <= s.e AND s.id <> p.l_orderkey)
GROUP BY ALL""")
def lineitem_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ship within the thirty days of another order of their customer."""
    joined = _lines(spark, sf_dir)
    hits = intervals.contained(joined, _order_spans(spark, sf_dir, 30), ["line"], 64, "inner").where("e.id <> p.l_orderkey")
    kept = hits.select("p.l_orderkey", "p.l_linenumber", "p.row").distinct()
    return kept.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("row"), days("l_shipdate").alias("start"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("line"))
    return l.join(o, "l_orderkey").withColumn("end", F.col("start") + 1)


@query("""
WITH s AS (SELECT o_custkey AS line, o_orderkey AS id, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 90 AS e FROM orders),
p AS (SELECT l_orderkey, o_custkey AS line, epoch(l_shipdate)::BIGINT // 86400 AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
d AS (SELECT DISTINCT l_orderkey, line, s FROM p),
n AS (SELECT d.l_orderkey, d.s, count(s.id) AS extents, min(d.s - s.s) AS offset_ FROM d LEFT JOIN s ON s.line = d.line AND s.s <= d.s AND d.s + 1 <= s.e GROUP BY d.l_orderkey, d.s)
SELECT l_orderkey, s AS day, extents, CASE WHEN extents = 1 THEN offset_ END AS "offset",
       CASE WHEN extents = 0 THEN 'missing' WHEN extents = 1 THEN 'mapped' ELSE 'ambiguous' END AS state FROM n""")
def lineitem_extent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each shipping day in the ninety-day extents of the customer's orders: mapped if in exactly one."""
    points = _lines(spark, sf_dir).select("l_orderkey", "line", "start", "end").distinct()
    both = intervals.contained(points, _order_spans(spark, sf_dir, 90), ["line"], 128, "left")
    n = both.groupBy("p.l_orderkey", F.col("p.start").alias("day")).agg(F.count("e.id").alias("extents"), F.min(F.col("p.start") - F.col("e.start")).alias("offset"))
    state = F.when(F.col("extents") == 0, "missing").when(F.col("extents") == 1, "mapped").otherwise("ambiguous")
    return n.select("l_orderkey", "day", "extents", F.when(F.col("extents") == 1, F.col("offset")).alias("offset"), state.alias("state"))


@query("""
WITH s AS (SELECT o_custkey AS line, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 30 AS e FROM orders),
p AS (SELECT l_orderkey, l_linenumber, o_custkey AS line, epoch(l_shipdate)::BIGINT // 86400 AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.line = p.line AND s.s <= p.s AND p.s + 1 <= s.e) GROUP BY ALL""")
def lineitem_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ship outside of all thirty-day extents of their customer: an anti join on ranges."""
    out = intervals.contained(_lines(spark, sf_dir), _order_spans(spark, sf_dir, 30), ["line"], 64, "left_anti")
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))


@query("""
WITH r AS (SELECT c.c_custkey, s.s_suppkey, abs(c.c_acctbal - s.s_acctbal) AS distance,
    row_number() OVER (PARTITION BY c.c_custkey ORDER BY abs(c.c_acctbal - s.s_acctbal), s.s_suppkey) AS k FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey)
SELECT c_custkey, s_suppkey, distance FROM r WHERE k = 1""")
def customer_nearest_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of a customer's nation with the closest balance, the smaller key of equals.

    Only the next supplier below and above can be closest. A nation's distinct balances are cut into stretches:
    running extremes go upward and downward within one, and one summary row a stretch tells what lies outside, so
    neither side is paired with all of the other. Suppliers whose balance is infinite, NaN or null are closest
    where there are no others, in this order, and to customers without a finite balance all finite ones are equal. Different balances that only
    the rounding of doubles puts at one distance (beyond some 10^13 with cents) do not count as equal.
    """
    b, inf, nan = F.col("b"), float("inf"), float("nan")
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("b"), "c_custkey").where("n IS NOT NULL")
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("b"), "s_suppkey").where("n IS NOT NULL")
    both = c.select("n", "b", F.lit(None).cast("long").alias("s_suppkey")).unionByName(s).groupBy("n", "b").agg(F.min("s_suppkey").alias("s_suppkey"))
    kind = F.when(b.isNull(), 4).when(F.isnan("b"), 3).when(b == inf, 2).when(b == -inf, 1).otherwise(0)
    both = both.withColumns({"kind": kind, "_stretch": F.when(kind == 0, F.floor(b / 64)).otherwise(0)})
    side = F.when((F.col("kind") == 0) & F.col("s_suppkey").isNotNull(), F.struct("b", "s_suppkey"))
    edges = both.groupBy("n", "_stretch").agg(F.max(side).alias("below"), F.min(side).alias("above"), *(F.min(F.when(F.col("kind") == k, F.col("s_suppkey"))).alias(f"k{k}") for k in range(5)))
    nation, inside = Window.partitionBy("n"), Window.partitionBy("n", "_stretch")
    before, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    outside = edges.select(
        F.col("n").alias("_n"), F.col("_stretch").alias("_of"), F.max("below").over(nation.orderBy("_stretch").rowsBetween(*before)).alias("_below"),
        F.min("above").over(nation.orderBy(F.desc("_stretch")).rowsBetween(*before)).alias("_above"), *(F.min(f"k{k}").over(nation).alias(f"k{k}") for k in range(5)),
    )
    both = both.join(outside, (F.col("n") == F.col("_n")) & (F.col("_stretch") == F.col("_of")))
    below = F.greatest(F.max(side).over(inside.orderBy("b").rowsBetween(*upto)), "_below")
    # a window whose frame ends at the last row is added up anew for every row, so this one is ordered downward
    above = F.least(F.min(side).over(inside.orderBy(F.desc("b")).rowsBetween(*upto)), "_above")
    both = both.withColumns({"below": below, "above": above})

    def near(value: Column, key: Column, there: Column) -> Column:
        distance = F.abs(b - value)
        return F.when(there & key.isNotNull(), F.struct(distance.isNull().alias("none"), distance.alias("distance"), key.alias("s_suppkey")))

    finite, always = F.col("kind") == 0, F.lit(True)
    sides = [near(F.col(f"{x}.b"), F.col(f"{x}.s_suppkey"), finite) for x in ("below", "above")]
    others = [near(F.lit(x).cast("double"), F.col(f"k{k}"), always if k else ~finite) for k, x in enumerate((0, -inf, inf, nan, None))]
    found = both.select(F.col("n").alias("_n"), b.alias("_b"), F.least(*sides, *others).alias("x")).where("x IS NOT NULL")
    return c.join(found, (F.col("n") == F.col("_n")) & b.eqNullSafe(F.col("_b"))).select("c_custkey", "x.s_suppkey", "x.distance")


@query("""
SELECT a.conv_id, a.turn, b.turn AS next_turn, length(a.text) - length(b.text) AS longer_by,
       CASE WHEN length(a.text) > 1.05 * length(b.text) THEN 'first' WHEN length(b.text) > 1.05 * length(a.text) THEN 'second' ELSE 'even' END AS longer
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1 AND a.turn < b.turn AND a.role <> b.role""")
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of different roles, as a band join: the partner's turn is a key."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("other"), F.col("n").alias("m"))
    both = c.join(b, ["conv_id", "turn"]).where("role <> other")
    longer = F.when(F.col("n") > 1.05 * F.col("m"), "first").when(F.col("m") > 1.05 * F.col("n"), "second").otherwise("even")
    return both.select("conv_id", "turn", (F.col("turn") + 1).alias("next_turn"), (F.col("n") - F.col("m")).cast("long").alias("longer_by"), longer.alias("longer"))


@query("""
SELECT coalesce(c_custkey, s_suppkey) AS key, c_nationkey, s_nationkey,
       CASE WHEN s_suppkey IS NULL THEN 'only_main' WHEN c_custkey IS NULL THEN 'only_mirror' WHEN c_nationkey = s_nationkey AND c_acctbal = s_acctbal THEN 'equal'
            WHEN c_nationkey = s_nationkey THEN 'same_place' ELSE 'different' END AS class
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def mirror_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of records compared key by key."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    both = c.join(s, c["c_custkey"] == s["s_suppkey"], "full")
    same = F.col("c_nationkey") == F.col("s_nationkey")
    kind = F.when(F.col("s_suppkey").isNull(), "only_main").when(F.col("c_custkey").isNull(), "only_mirror").when(same & (F.col("c_acctbal") == F.col("s_acctbal")), "equal").when(same, "same_place").otherwise("different")
    return both.select(F.coalesce("c_custkey", "s_suppkey").alias("key"), "c_nationkey", "s_nationkey", kind.alias("class"))


# --- links, trees, resolution ---------------------------------------------------------------------


@query("""
WITH p AS (SELECT o_custkey % 97 AS line, o_orderkey // 97 AS page, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey // 97 + 1 END AS next,
                  CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey // 97 - 1 END AS prev FROM orders),
s AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY line, page) AS n FROM p) WHERE n = 1)
SELECT a.line, a.page, CASE WHEN a.next = 0 THEN 'end' WHEN b.page IS NULL THEN 'missing' WHEN b.prev = a.page THEN 'confirmed' ELSE 'mismatch' END AS link
FROM s a LEFT JOIN s b ON a.line = b.line AND a.next = b.page""")
def orders_link_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages that name the next and the one before: which links hold from both sides."""
    key, page = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 97)
    p = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("line"), page.alias("page"), F.when(key % 5 == 0, 0).otherwise(page + 1).alias("next"), F.when(key % 7 == 0, 0).otherwise(page - 1).alias("prev"))
    return graph.reciprocal_links(p, ["line"]).select("line", "page", "link")


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS structural, count(*) FILTER (o_orderstatus = 'O') AS fragments, count(*) FILTER (o_orderstatus = 'P') AS rejected,
       CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 1 THEN 'structural' WHEN count(*) FILTER (o_orderstatus = 'F') > 1 THEN 'ambiguous'
            WHEN count(*) FILTER (o_orderstatus = 'O') = 1 THEN 'fragment' WHEN count(*) FILTER (o_orderstatus = 'O') > 1 THEN 'ambiguous'
            WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'rejected' ELSE 'missing' END AS resolution FROM orders GROUP BY o_custkey""")
def orders_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a customer's orders is the one: exactly one structural candidate, else exactly one fragment."""
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(n("F").alias("structural"), n("O").alias("fragments"), n("P").alias("rejected"))
    return g.withColumn("resolution", findings.resolved(F.col("structural"), F.col("fragments"), F.col("rejected")))


@query("""
SELECT 'c' || c_custkey AS node, r_name || '/' || n_name || '/' || c_name AS path, 'complete' AS state, 2::BIGINT AS hops
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || c_custkey, c_name, 'missing', 0 FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def customer_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path of each customer through nation and region, by following parents."""
    name = lambda t, k, n, p, w: read(spark, sf_dir, t).select(F.concat(F.lit(t[0]), F.col(k).cast("string")).alias("node"), p.alias("parent"), F.col(n).alias("name"), F.lit(w).alias("wanted"))
    nodes = name("customer", "c_custkey", "c_name", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), True)
    nodes = nodes.unionByName(name("nation", "n_nationkey", "n_name", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), False))
    nodes = nodes.unionByName(name("region", "r_regionkey", "r_name", F.lit(None).cast("string"), False))
    return graph.ancestors(nodes).select("node", F.array_join("path", "/").alias("path"), "state", F.col("hops").cast("long").alias("hops"))


@query("""
SELECT DISTINCT 'p' || p_partkey AS tree, 'p' || p_partkey AS page, 0::BIGINT AS level, 0::BIGINT AS parents FROM part
UNION ALL SELECT DISTINCT 'p' || p_partkey, 's' || l_suppkey, 1, 1 FROM part JOIN lineitem ON l_partkey = p_partkey
UNION ALL SELECT 'p' || p_partkey, 'n' || s_nationkey, 2, count(DISTINCT s_suppkey) FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey
GROUP BY p_partkey, s_nationkey""")
def part_tree_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of every part with its suppliers and their nations: level and number of parents of each page."""
    page = lambda kind, k: F.concat(F.lit(kind), F.col(k).cast("string"))
    l = read(spark, sf_dir, "lineitem").select(page("p", "l_partkey").alias("parent"), page("s", "l_suppkey").alias("child"))
    s = read(spark, sf_dir, "supplier").select(page("s", "s_suppkey").alias("parent"), page("n", "s_nationkey").alias("child"))
    roots = read(spark, sf_dir, "part").select(page("p", "p_partkey").alias("tree"), page("p", "p_partkey").alias("page")).distinct()
    return graph.tree(l.unionByName(s).distinct(), roots).select("tree", "page", F.col("level").cast("long").alias("level"), "parents")


# --- findings: dedup, policy, roll-ups -------------------------------------------------------------

STATUS_SQL = """f AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 'REJECTED' WHEN 'A' THEN 'STRUCTURAL' ELSE 'FRAGMENT' END AS structural,
    CASE WHEN l_linestatus = 'O' THEN 'UNVALIDATED' WHEN l_linenumber % 4 = 0 THEN 'CHECKSUM_INVALID' WHEN l_linenumber % 4 = 1 THEN 'CHECKSUM_VALID' ELSE 'INSUFFICIENT_EXPORT_STRUCTURE' END AS validation,
    'supplier-' || (l_suppkey % 5) AS target, l_linenumber % 3 AS kind FROM lineitem)"""


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read as findings, with words of the status vocabulary."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    structural = F.when(flag == "R", "REJECTED").when(flag == "A", "STRUCTURAL").otherwise("FRAGMENT")
    validation = F.when(F.col("l_linestatus") == "O", "UNVALIDATED").when(line % 4 == 0, "CHECKSUM_INVALID").when(line % 4 == 1, "CHECKSUM_VALID").otherwise("INSUFFICIENT_EXPORT_STRUCTURE")
    return read(spark, sf_dir, "lineitem").withColumns({
        "structural": findings.checked(structural, findings.STRUCTURAL_WORDS), "validation": findings.checked(validation, findings.VALIDATION_WORDS),
        "target": F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 5).cast("string")), "kind": line % 3,
    })


@query(f"""
WITH {STATUS_SQL}
SELECT target, kind, structural, validation, count(*) AS findings, min(l_orderkey) AS first_at, max(l_orderkey) AS last_at FROM f
WHERE (structural = 'REJECTED' OR validation = 'REJECTED') AND kind <> 2 GROUP BY ALL""")
def rejected_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected findings folded by kind and state, except the kind that is always kept whole."""
    f = line_findings(spark, sf_dir).where("(structural = 'REJECTED' OR validation = 'REJECTED') AND kind <> 2")
    return f.groupBy("target", "kind", "structural", "validation").agg(F.count("*").alias("findings"), F.min("l_orderkey").alias("first_at"), F.max("l_orderkey").alias("last_at"))


@query(f"""
WITH {STATUS_SQL}
SELECT target, count(*) AS findings, count(*) FILTER (structural = 'REJECTED' OR validation = 'REJECTED') AS rejected, count(*) FILTER (structural <> 'REJECTED' AND validation = 'UNVALIDATED') AS pending,
       count(*) FILTER (structural <> 'REJECTED' AND validation = 'CHECKSUM_VALID') AS valid, count(DISTINCT l_partkey) FILTER (structural <> 'REJECTED' AND validation = 'CHECKSUM_VALID') AS distinct_valid FROM f GROUP BY target""")
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by target, distinct fingerprints among them."""
    open_ = F.col("structural") != "REJECTED"
    valid = open_ & (F.col("validation") == "CHECKSUM_VALID")
    return line_findings(spark, sf_dir).groupBy("target").agg(
        F.count("*").alias("findings"), F.count_if((F.col("structural") == "REJECTED") | (F.col("validation") == "REJECTED")).alias("rejected"),
        F.count_if(open_ & (F.col("validation") == "UNVALIDATED")).alias("pending"), F.count_if(valid).alias("valid"), F.countDistinct(F.when(valid, F.col("l_partkey"))).alias("distinct_valid"),
    )


@query(f"""
WITH {STATUS_SQL},
g AS (SELECT structural, validation, kind = 2 AS context, count(*) AS n FROM f GROUP BY ALL)
SELECT structural, validation, context, n,
    CASE WHEN structural = 'REJECTED' OR validation IN ('CHECKSUM_INVALID', 'INSUFFICIENT_EXPORT_STRUCTURE') THEN 'REJECTED' WHEN validation = 'CHECKSUM_VALID' OR structural = 'STRUCTURAL' THEN 'ACCEPTED'
         WHEN structural = 'FRAGMENT' AND NOT context THEN 'CANDIDATE' ELSE 'RAW' END AS discovery,
    CASE WHEN context OR structural = 'REJECTED' THEN 'NONE' ELSE 'FRAGMENT' END AS structure,
    CASE WHEN validation = 'CHECKSUM_VALID' THEN 'VALID' WHEN validation = 'CHECKSUM_INVALID' THEN 'INVALID' WHEN context THEN 'NOT_APPLICABLE' ELSE 'UNCHECKED' END AS crypto,
    CASE WHEN context OR structural = 'REJECTED' OR validation IN ('CHECKSUM_INVALID', 'INSUFFICIENT_EXPORT_STRUCTURE') OR (validation <> 'CHECKSUM_VALID' AND structural <> 'STRUCTURAL') THEN 'CONTEXT_REVIEW' ELSE 'INDEPENDENT' END AS relevance FROM g""")
def finding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four axes of public state for each combination of statuses; kind 2 is a mere address."""
    g = line_findings(spark, sf_dir).groupBy("structural", "validation", (F.col("kind") == 2).alias("context")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("context"), "bitcoin_address").otherwise("mnemonic")
    return g.withColumn("state", findings.state(F.col("structural"), F.col("validation"), kind)).select("structural", "validation", "context", "n", "state.*")


@query(f"""
WITH {STATUS_SQL},
h AS (SELECT l_orderkey, l_linenumber, 'type-' || kind AS type, l_returnflag AS kind, structural, validation, CASE WHEN l_suppkey % 5 = 0 THEN 'unknown' ELSE target END AS target FROM f),
s AS (SELECT *, CASE WHEN validation IN ('CHECKSUM_INVALID', 'INSUFFICIENT_EXPORT_STRUCTURE') THEN 0
    WHEN structural = 'STRUCTURAL' AND validation <> 'UNVALIDATED' THEN 2 WHEN structural = 'FRAGMENT' OR target = 'unknown' THEN 1 ELSE 0 END AS strength FROM h),
p AS (SELECT l_orderkey, max(pairs) AS pairs FROM (SELECT l_orderkey, target, count(DISTINCT (kind, type)) AS pairs FROM s WHERE target <> 'unknown' GROUP BY ALL) GROUP BY l_orderkey),
g AS (SELECT l_orderkey, count(*) AS hits, count(DISTINCT type) AS types, bool_or(target <> 'unknown') AS known, CASE WHEN bool_or(target <> 'unknown') THEN max(strength) ELSE 0 END AS strongest,
        max(l_linenumber) - min(l_linenumber) AS span, bool_or(type = 'type-1') AND bool_or(type IN ('type-0', 'type-2')) AS required FROM s GROUP BY l_orderkey)
SELECT l_orderkey, hits, strongest::BIGINT AS strongest, array_to_string(list_filter([CASE WHEN strongest < 2 AND hits < 2 THEN 'insufficient_hits' END, CASE WHEN strongest < 2 AND types < 2 THEN 'insufficient_distinct_types' END,
    CASE WHEN known AND strongest < 2 AND pairs < 2 THEN 'weak_evidence_requires_independent_corroboration' END, CASE WHEN NOT required THEN 'missing_required_group' END, CASE WHEN span > 5 THEN 'signal_span_too_large' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM g LEFT JOIN p USING (l_orderkey)""")
def orders_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's lines, read as hits, make a candidate: the reasons against it, in order. Every fifth supplier is no known target."""
    target = F.when(F.col("l_suppkey") % 5 == 0, "unknown").otherwise(F.col("target"))
    f = line_findings(spark, sf_dir).withColumn("target", target)
    hits = f.select(
        "l_orderkey", F.col("l_linenumber").alias("start"), F.concat(F.lit("type-"), F.col("kind").cast("string")).alias("hit_type"), "target", F.col("l_returnflag").alias("kind"),
        findings.strength(F.col("target"), F.col("structural"), F.col("validation")).alias("strength"),
    )
    g = findings.policy(hits, ["l_orderkey"], 2, 2, 5, [{"type-1"}, {"type-0", "type-2"}])
    return g.select("l_orderkey", "hits", F.col("strongest").cast("long").alias("strongest"), F.array_join("reasons", ",").alias("reasons"))


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS k FROM lineitem) WHERE k = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each part and supplier, in scan order."""
    l = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return findings.first_of(l, ["l_partkey", "l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")])


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS copies, count(DISTINCT l_partkey) AS payloads, count(DISTINCT l_partkey) > 1 AS conflict FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def dedup_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under one address: duplicates if they say the same, else a conflict."""
    return findings.conflicts(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"))


@query("""
SELECT sha256(text) AS fingerprint, count(*) AS occurrences, array_to_string(list_sort(list(doc_id)), ',') AS offsets FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def occurrence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once: fingerprint, count and sorted offsets."""
    g = read(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))
    g = g.agg(F.count("*").alias("occurrences"), F.sort_array(F.collect_list("doc_id")).alias("at")).where("occurrences > 1")
    return g.select("fingerprint", "occurrences", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("offsets"))


@query("""
WITH g AS (SELECT sha256(text) AS f, count(*) AS n FROM documents GROUP BY 1)
SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' ELSE 'more' END AS bucket, count(*) AS groups, sum(n)::BIGINT AS occurrences FROM g GROUP BY 1""")
def occurrence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often texts occur, in buckets."""
    g = read(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("f")).agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 3, "2-3").when(F.col("n") <= 10, "4-10").otherwise("more")
    return g.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("groups"), F.sum("n").alias("occurrences"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|blue|green) ') AND p_size < 25 THEN 'match' WHEN regexp_matches(p_name, 'ring|bolt$') THEN 'like' ELSE 'context' END AS class FROM part
WHERE regexp_matches(p_name, 'ring|bolt|widget') OR p_type = 'ECONOMY'""")
def part_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts by name: a match, something like it, or mere context."""
    name = F.col("p_name")
    kind = F.when(name.rlike("^(red|blue|green) ") & (F.col("p_size") < 25), "match").when(name.rlike("ring|bolt$"), "like").otherwise("context")
    return read(spark, sf_dir, "part").where(name.rlike("ring|bolt|widget") | (F.col("p_type") == "ECONOMY")).select("p_partkey", kind.alias("class"))


@query("""
(SELECT vec_id, label, 'artifact' AS why FROM embeddings WHERE label = 0) UNION ALL (SELECT vec_id, label, 'sample' FROM embeddings WHERE label <> 0 ORDER BY vec_id LIMIT 100)""")
def embeddings_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All artifacts, and the first hundred other rows as a sample."""
    all_, some = findings.capped_sample(read(spark, sf_dir, "embeddings").select("vec_id", "label"), F.col("label") == 0, [F.col("vec_id")], 100)
    return all_.withColumn("why", F.lit("artifact")).unionByName(some.withColumn("why", F.lit("sample")))


@query("""
SELECT r_name, count(*) AS customers, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery,
       count(*) FILTER (c_acctbal < 0) AS negative FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def customer_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by region and kind, as a report's summary table."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    d = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    kind = lambda k: F.count_if(F.col("c_mktsegment") == k)
    return d.groupBy("r_name").agg(F.count("*").alias("customers"), kind("BUILDING").alias("building"), kind("AUTOMOBILE").alias("automobile"), kind("MACHINERY").alias("machinery"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))


# --- text -----------------------------------------------------------------------------------------

SIGNATURE_SQL = "s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS signature, p.start, p.start + {len(t)} AS end_ FROM (SELECT doc_id, string_split(text, '{t}') AS x FROM documents WHERE contains(text, '{t}')) d, "
    f"LATERAL (SELECT list_sum(list_transform(x[1:i], lambda y: strlen(y)))::BIGINT + (i - 1) * {len(t)} AS start FROM range(1, len(x)) r(i)) p"
    for n, t in SIGNATURES
) + ")"


@query(f"WITH {SIGNATURE_SQL} SELECT doc_id, signature, start, end_ AS \"end\" FROM s")
def documents_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the byte patterns occur in the documents."""
    return text.signatures(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", SIGNATURES)


@query(f"""
WITH {SIGNATURE_SQL},
f AS (SELECT *, CASE WHEN start - lag(start) OVER w > 256 THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY start, end_, signature)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY start, end_, signature ROWS UNBOUNDED PRECEDING) AS island FROM f),
g AS (SELECT doc_id, island, count(*) AS hits, list_sort(list(DISTINCT signature)) AS types, min(start) AS a, max(start) AS b, max(end_) AS c FROM i GROUP BY doc_id, island),
n AS (SELECT g.*, strlen(text) AS size FROM g JOIN documents USING (doc_id))
SELECT doc_id, island::BIGINT AS island, hits, array_to_string(types, ',') AS hit_types, greatest(0, a - 64)::BIGINT AS start, least(size, c + 64)::BIGINT AS "end",
       array_to_string(list_filter([CASE WHEN hits < 2 THEN 'insufficient_hits' END, CASE WHEN len(types) < 2 THEN 'insufficient_distinct_types' END, CASE WHEN b - a > 4096 THEN 'signal_span_too_large' END], lambda x: x IS NOT NULL), ',') AS reasons FROM n""")
def documents_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotspots of byte patterns in the documents, and why a hotspot is not a candidate."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = text.signatures(docs, "doc_id", "text", SIGNATURES).withColumnRenamed("signature", "hit_type")
    found = intervals.hotspots(hits, ["doc_id"], 256, 64, F.lit(0).cast("long"), F.lit(1 << 62), 1 << 20)
    found = found.join(docs.select("doc_id", F.octet_length("text").cast("long").alias("size")), "doc_id").withColumn("end", F.least("end", "size"))
    why = findings.reasons(F.col("hits"), F.size("hit_types"), F.lit(0), F.lit(False), F.lit(0), F.lit(True), F.col("last_start") - F.col("first_start"), 2, 2, 4096)
    return found.select("doc_id", "island", "hits", F.array_join("hit_types", ",").alias("hit_types"), "start", "end", F.array_join(why, ",").alias("reasons"))


RUN_SQL = f"""t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), 1) - 1 AS i FROM documents),
k AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t WHERE w IN ({", ".join(f"'{w}'" for w in DICTIONARY)})),
r AS (SELECT doc_id, min(i)::BIGINT AS first_token, count(*) AS length FROM k GROUP BY doc_id, run HAVING count(*) >= 4)"""


@query(f"WITH {RUN_SQL} SELECT * FROM r")
def documents_token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of four or more dictionary words."""
    return text.token_runs(read(spark, sf_dir, "documents"), "doc_id", "text", DICTIONARY, 4)


@query(f"WITH {RUN_SQL} SELECT doc_id, words, sum(length - words + 1)::BIGINT AS windows FROM r, range(4, 7) x(words) WHERE words <= length GROUP BY doc_id, words")
def documents_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four to six words within the runs."""
    return text.windows(documents_token_runs(spark, sf_dir), "doc_id", 4, 6)


#: What the byte patterns are evidence of, and how strong: (target, rank in STRENGTHS).
ADMISSION = {"at_sign": ("secrets", 0), "license": ("unknown", 1), "of_the": ("electrum", 0), "und_d": ("electrum", 0), "de_la": ("bitcoin", 1)}


@query(f"""
WITH {SIGNATURE_SQL},
w AS (SELECT * FROM s WHERE signature NOT IN ('license', 'de_la')),
f AS (SELECT *, CASE WHEN start - lag(start) OVER w1 > 2048 THEN 1 ELSE 0 END AS cut FROM w WINDOW w1 AS (PARTITION BY doc_id ORDER BY start, end_, signature)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY start, end_, signature ROWS UNBOUNDED PRECEDING) AS island FROM f),
k AS (SELECT doc_id, island FROM i GROUP BY ALL HAVING count(DISTINCT signature) >= 2)
SELECT i.doc_id, signature, start FROM i JOIN k ON i.doc_id = k.doc_id AND i.island = k.island UNION ALL SELECT doc_id, signature, start FROM s WHERE signature IN ('license', 'de_la')""")
def documents_weak_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that are admitted: all that corroborate or say more, or whose target is unknown, and weak ones that another kind of weak hit backs within a cluster."""
    names = F.create_map(*(F.lit(x) for n, (target, rank) in ADMISSION.items() for x in (n, target))), F.create_map(*(F.lit(x) for n, (target, rank) in ADMISSION.items() for x in (n, rank)))
    hits = documents_signatures(spark, sf_dir).withColumns({"target": names[0][F.col("signature")], "rank": names[1][F.col("signature")]})
    return findings.admitted(hits, ["doc_id"], 2048, 1 << 20).select("doc_id", "signature", "start")


@query("""
WITH u AS (SELECT doc_id, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
x AS (SELECT doc_id, n, unnest(range(0, n, 3840)) AS s FROM u), y AS (SELECT *, least(s + 4096, n) AS e FROM x)
SELECT doc_id, s AS scan_start, e AS scan_end, CASE WHEN e >= n THEN n ELSE least(s + 3840, n) END AS own_end FROM y WHERE s = 0 OR s - 3840 + 4096 < n""")
def unit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of 4,096 bytes, overlapping by 256, over each document's bytes."""
    from ..sources.units import units

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.octet_length("text").cast("long").alias("size"))
    return units(docs, 4096, 256).select(F.col("source_id").alias("doc_id"), "scan_start", "scan_end", "own_end")


@query("""
SELECT page_id, contains(lower(html), '<script') AS has_script, contains(lower(html), '<style') AS has_style, contains(lower(html), '<nav') AS has_nav, contains(lower(html), 'example') AS has_example,
       CASE WHEN contains(lower(html), '<script') AND contains(lower(html), '<style') THEN 'rejected' WHEN contains(lower(html), '<nav') THEN 'candidate' ELSE 'inconclusive' END AS verdict FROM pages""")
def pages_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers around a finding, and the verdict that follows from them."""
    p = read(spark, sf_dir, "pages").select("page_id", *text.markers(F.col("html"), ("<script", "<style", "<nav", "example")))
    verdict = F.when(F.col("has_script") & F.col("has_style"), "rejected").when(F.col("has_nav"), "candidate").otherwise("inconclusive")
    return p.withColumn("verdict", verdict)


@query("""
SELECT event_id, CASE WHEN json_valid(props) AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'wallet' WHEN json_valid(props) THEN 'other' ELSE 'broken' END AS shape, (props->>'$.k')::BIGINT AS k FROM events""")
def events_json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON checked for shape: a whole number under the key, not a truth value or a string."""
    v = F.try_parse_json("props")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    shape = F.when(v.isNull(), "broken").when(kind == "BIGINT", "wallet").otherwise("other")
    return read(spark, sf_dir, "events").select("event_id", shape.alias("shape"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("""
SELECT doc_id, strlen(text) AS bytes, sha256(text) AS digest, sha256(unhex(sha256(text))) AS digest_twice, md5(text) AS md5 FROM documents""")
def documents_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the documents' bytes, single and double."""
    b = F.col("text").cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2(b, 256).alias("digest"), F.sha2(F.unhex(F.sha2(b, 256)), 256).alias("digest_twice"), F.md5(b).alias("md5"))


@query("""
WITH u AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders), d AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber >= 4)
SELECT o_orderkey, o_custkey FROM u WHERE o_orderkey NOT IN (SELECT l_orderkey FROM d)""")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that a resumed run still has to do: all but the finished."""
    done = read(spark, sf_dir, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


# --- scans of bytes --------------------------------------------------------------------------------


@query(f"WITH {SIGNATURE_SQL} SELECT doc_id, signature, start, end_ AS \"end\" FROM s")
def signature_scan_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All byte patterns in one pass over the documents' bytes."""
    from ..functions import scan

    units = scan.text_units(read(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    hits = scan.deduplicated(scan.scan(units, [(n, t.encode()) for n, t in SIGNATURES]))
    return hits.select(F.col("source_id").alias("doc_id"), "signature", "start", "end")


@query()
def address_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text table its texts, and the address and public key shapes in them by what they proved to be."""
    from ..functions import addresses

    out = None
    for name, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
        rows = read(spark, sf_dir, name).select(key, column)
        found = addresses.find(rows, key, F.col(column)).select("state", "fingerprint")
        both = found.unionByName(rows.select(F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("fingerprint")))
        part = both.groupBy(F.lit(name).alias("source")).agg(
            F.count_if(F.col("state").isNull()).alias("texts"), F.count("state").alias("shapes"),
            F.count_if(F.col("state") != "invalid").alias("valid"), F.countDistinct(F.when(F.col("state") != "invalid", F.col("fingerprint"))).alias("distinct_valid"),
        )
        out = part if out is None else out.unionByName(part)
    return out


# --- places and distances --------------------------------------------------------------------------


@query(f"""
WITH {SIGNATURE_SQL},
f AS (SELECT *, CASE WHEN start - lag(start) OVER w > 2048 THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY start, end_)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (PARTITION BY doc_id ORDER BY start, end_, signature) AS k FROM f)
SELECT a.doc_id, a.island::BIGINT AS island, count(*) AS pairs, min(b.start - a.start) AS nearest, max(b.start - a.start) AS farthest, sum(b.start - a.start)::DOUBLE / count(*) AS mean
FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.island = b.island AND a.k < b.k GROUP BY ALL""")
def documents_pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all hits of a cluster, from their order: no pair is formed.

    In order, the i-th of n starts is the later one of i - 1 pairs and the earlier one of n - i.
    """
    found = intervals.islands(documents_signatures(spark, sf_dir), ["doc_id"], 2048, "start", 1 << 20)
    cluster = Window.partitionBy("doc_id", "island")
    ordered = cluster.orderBy("start", "end", "signature")
    found = found.withColumns({"i": F.row_number().over(ordered), "n": F.count("*").over(cluster), "step": F.col("start") - F.lag("start").over(ordered)})
    pairs = (F.max("n") * (F.max("n") - 1) / 2).cast("long")
    g = found.groupBy("doc_id", "island").agg(
        pairs.alias("pairs"), F.min("step").alias("nearest"), (F.max("start") - F.min("start")).alias("farthest"), F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("start")).alias("total")
    )
    return g.where("pairs > 0").select("doc_id", "island", "pairs", "nearest", "farthest", (F.col("total").cast("double") / F.col("pairs")).alias("mean"))


@query("""
WITH m AS (SELECT o_custkey, bit_or(1::BIGINT << (o_orderkey % 48)::INTEGER) AS bits FROM orders GROUP BY o_custkey),
r AS (SELECT c_custkey, coalesce(bits, 0) AS bits, (c_custkey % 40)::INTEGER AS first, (c_custkey % 8 + 1)::INTEGER AS n FROM customer LEFT JOIN m ON o_custkey = c_custkey),
s AS (SELECT *, bit_count((bits >> first) & ((1::BIGINT << n) - 1))::BIGINT AS used FROM r)
SELECT c_custkey, n::BIGINT AS clusters, used, CASE WHEN used = 0 THEN 'UNALLOCATED' WHEN used = n THEN 'ALLOCATED' ELSE 'MIXED' END AS state FROM s""")
def customer_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a range of clusters is allocated, by the bits of a bitmap."""
    m = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bit_or(F.expr("shiftleft(1L, cast(o_orderkey % 48 AS INT))")).alias("bits"))
    r = read(spark, sf_dir, "customer").select("c_custkey").join(m, "c_custkey", "left").withColumns({"bits": F.coalesce("bits", F.lit(0)), "clusters": F.col("c_custkey") % 8 + 1})
    used = F.expr("cast(bit_count(shiftrightunsigned(bits, cast(c_custkey % 40 AS INT)) & (shiftleft(1L, cast(clusters AS INT)) - 1)) AS BIGINT)")
    state = F.when(F.col("used") == 0, "UNALLOCATED").when(F.col("used") == F.col("clusters"), "ALLOCATED").otherwise("MIXED")
    return r.withColumn("used", used).select("c_custkey", "clusters", "used", state.alias("state"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_quantity = a.l_quantity AND b.l_orderkey <> a.l_orderkey) THEN 'BYTE_IDENTICAL'
    WHEN EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_orderkey <> a.l_orderkey) THEN 'STRUCTURALLY_SIMILAR'
    WHEN EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_quantity = a.l_quantity AND b.l_orderkey <> a.l_orderkey) THEN 'SIZE_MATCH_ONLY' ELSE 'NO_MATCH' END AS class
FROM lineitem a""")
def fingerprint_compare_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest class of match of each line with the lines of the same part in other orders; lines without a partner are NO_MATCH.

    Another order has the same fingerprint exactly if the fingerprint's smallest and largest order differ, so no pairs are built.
    """
    out = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    kinds = {"same": ["l_partkey", "l_suppkey", "l_quantity"], "similar": ["l_partkey", "l_suppkey"], "size": ["l_partkey", "l_quantity"]}
    lines = out
    for kind, keys in kinds.items():
        shared = lines.groupBy(*keys).agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high")).where("low < high").select(*keys, F.lit(True).alias(kind))
        out = out.join(shared, keys, "left")
    named = F.when(F.col("same"), "BYTE_IDENTICAL").when(F.col("similar"), "STRUCTURALLY_SIMILAR").when(F.col("size"), "SIZE_MATCH_ONLY").otherwise("NO_MATCH")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", named.alias("class"))


from . import evidence, structures, volumes  # noqa: E402, F401  (register their queries)
