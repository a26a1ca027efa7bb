"""Per-group values and picks, trajectories and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom import functions as fn
from cohortloom import operators as op
from workload.registry import query, rounded, table

BASE = 'SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events'


def lines(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
                                          "l_linestatus")


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("group_size", f"SELECT {LINE}, count(*) OVER (PARTITION BY l_orderkey) AS group_size FROM lineitem")
def _(s, d):
    return op.group_size(lines(s, d).drop("l_returnflag", "l_linestatus"), ["l_orderkey"])


@query(
    "group_any_flag",
    f"""SELECT {LINE}, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w AS any_returned,
        max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 ELSE 0 END) OVER w AS any_closed FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey)""",
)
def _(s, d):
    out = op.group_any_flag(
        lines(s, d), ["l_orderkey"],
        {
            "any_returned": F.col("l_returnflag") == "R",
            "any_closed": (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"),
        },
    )
    return out.drop("l_returnflag", "l_linestatus")


@query(
    "group_cond_count",
    f"""SELECT {LINE}, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS BIGINT)
        AS n_returned FROM lineitem""",
)
def _(s, d):
    out = op.group_cond_count(lines(s, d), ["l_orderkey"], {"n_returned": F.col("l_returnflag") == "R"})
    return out.drop("l_returnflag", "l_linestatus")


@query(
    "composite_group_flag",
    """SELECT l_orderkey, CASE WHEN r = 1 AND a = 1 THEN 1 WHEN a = 1 AND n > 3 THEN 1 ELSE 0 END AS serious FROM
       (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r,
               max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS a, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def _(s, d):
    per = lines(s, d).groupBy("l_orderkey").agg(
        F.max(fn.flag(F.col("l_returnflag") == "R")).alias("r"),
        F.max(fn.flag(F.col("l_linestatus") == "F")).alias("a"),
        F.count(F.lit(1)).alias("n"),
    )
    rules = [(F.col("r") == 1) & (F.col("a") == 1), (F.col("a") == 1) & (F.col("n") > 3)]
    return op.composite_group_flag(per, "serious", rules).select("l_orderkey", "serious")


ORDERS = "(SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 0 END AS hot FROM orders)"


def orders_hot(s, d):
    p = F.col("o_orderpriority")
    return table(s, d, "orders").withColumn(
        "hot", F.when(p.isin("1-URGENT", "2-HIGH"), 1).when(p == "5-LOW", F.lit(None)).otherwise(0)
    )


@query(
    "priority_sort",
    f"""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY hot DESC NULLS LAST,
        o_orderdate NULLS LAST, o_orderkey) AS position FROM {ORDERS}""",
)
def _(s, d):
    o = orders_hot(s, d).select("o_orderkey", "o_custkey", "hot", "o_orderdate")
    return op.priority_sort(o, ["o_custkey"], [("hot", "desc"), "o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "o_custkey", "position"
    )


@query(
    "first_per_group_priority",
    f"""SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM (SELECT *, row_number() OVER
        (PARTITION BY o_custkey ORDER BY hot DESC NULLS LAST, o_orderdate, o_orderkey) AS rn FROM {ORDERS}) WHERE rn = 1""",
)
def _(s, d):
    o = orders_hot(s, d).select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "hot")
    return op.first_per_group_priority(o, ["o_custkey"], [("hot", "desc"), "o_orderdate", "o_orderkey"]).drop("hot")


@query(
    "latest_per_group",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER
       (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return op.latest_per_group(o, ["o_custkey"], "o_orderdate", "o_orderkey")


@query(
    "min_date_ties",
    f"""SELECT {LINE}, l_shipdate FROM (SELECT *, min(l_shipdate) OVER (PARTITION BY l_orderkey, l_returnflag) AS m
        FROM lineitem) WHERE l_shipdate = m""",
)
def _(s, d):
    li = table(s, d, "lineitem").select(*LINE.split(", "), "l_returnflag", "l_shipdate")
    return op.min_date_ties(li, ["l_orderkey", "l_returnflag"], "l_shipdate").drop("l_returnflag")


@query(
    "max_value_min_date",
    f"""SELECT {LINE}, l_quantity, l_shipdate FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY
        l_quantity DESC, l_shipdate) AS rk FROM lineitem) WHERE rk = 1""",
)
def _(s, d):
    li = table(s, d, "lineitem").select(*LINE.split(", "), "l_quantity", "l_shipdate")
    return op.max_value_min_date(li, ["l_suppkey"], "l_quantity", "l_shipdate")


@query(
    "strict_group_max",
    f"""SELECT {LINE}, CASE WHEN min(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) = 1
        THEN max(l_shipdate) OVER (PARTITION BY l_orderkey) END AS last_clean FROM lineitem""",
)
def _(s, d):
    li = table(s, d, "lineitem").select(*LINE.split(", "), "l_returnflag", "l_shipdate")
    out = op.strict_group_max(li, ["l_orderkey"], F.col("l_returnflag") != "N", "l_shipdate", "last_clean")
    return out.drop("l_returnflag", "l_shipdate")


# --- ordered per group -------------------------------------------------------------


def sessions(s, d):
    return table(s, d, "events").select("event_id", "user_id", "ts", "value")


ORDER = ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    "lag_days",
    f"""SELECT event_id, coalesce(CAST(date_diff('day', CAST(lag(ts) {W} AS DATE), CAST(ts AS DATE)) AS INT), 0) AS lag_days
        FROM events""",
)
def _(s, d):
    return op.lag_days(sessions(s, d), ["user_id"], ORDER, "ts").select("event_id", "lag_days")


@query("lag_score", f"SELECT event_id, round(value - lag(value) {W}, 6) AS lag_score FROM events")
def _(s, d):
    return rounded(op.lag_score(sessions(s, d), ["user_id"], ORDER, "value").select("event_id", "lag_score"), "lag_score")


@query(
    "running_days",
    """SELECT o_orderkey, CAST(sum(gap) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)
       AS INT) AS running_days FROM (SELECT *, coalesce(date_diff('day', lag(o_orderdate) OVER
         (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate), 0) AS gap FROM orders)""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return op.running_days(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate").select(
        "o_orderkey", "running_days"
    )


@query(
    "baseline_diff",
    f"""SELECT event_id, round(base, 6) AS score_base, round(score - base, 6) AS score_bdiff,
        round((score - base) / nullif(base, 0), 6) AS score_pctdiff FROM
        (SELECT *, CASE WHEN first IS NULL THEN NULL WHEN n > 1 THEN greatest(first, 0) ELSE first END AS base FROM
          (SELECT *, first_value(score) {W} AS first, count(*) OVER (PARTITION BY user_id) AS n FROM
            (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value - 20 END AS score FROM events)))""",
)
def _(s, d):
    e = table(s, d, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value") - 20).alias("score")
    )
    out = op.baseline_diff(e, ["user_id"], ORDER, ["score"], pct=True)
    return rounded(
        out.select("event_id", "score_base", "score_bdiff", "score_pctdiff"),
        "score_base", "score_bdiff", "score_pctdiff",
    )


@query("session_number", f"SELECT event_id, user_id, row_number() {W} AS session_number FROM events")
def _(s, d):
    return op.session_number(sessions(s, d).select("event_id", "user_id", "ts"), ["user_id"], ORDER).drop("ts")


@query(
    "regroup_sizes",
    """SELECT o_orderkey, count(*) OVER (PARTITION BY date_trunc('month', o_orderdate)) AS n_per_month,
       count(*) OVER (PARTITION BY o_orderdate) AS n_per_day FROM orders""",
)
def _(s, d):
    o = table(s, d, "orders").select(
        "o_orderkey", F.date_trunc("month", "o_orderdate").alias("month"), F.col("o_orderdate").alias("day")
    )
    return op.regroup_sizes(o, {"month": "n_per_month", "day": "n_per_day"}).drop("month", "day")


BINS = """CASE WHEN days_from_first = 0 THEN '0. Baseline' WHEN days_from_first <= 30 THEN '1-30 Days'
  WHEN days_from_first <= 60 THEN '31-60 Days' ELSE '61-90 Days' END"""


def trajectory_sql(rows: str, extra: str) -> str:
    """Window-function version over prepared rows with columns k, ts, id, name and scores."""
    return f"""
    WITH rows_ AS ({rows}),
    seq AS (SELECT *, row_number() OVER w AS session_number, count(*) OVER (PARTITION BY k) AS size_,
        coalesce(CAST(date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS INT), 0) AS days_between
        FROM rows_ WINDOW w AS (PARTITION BY k ORDER BY ts, id)),
    run AS (SELECT *, CAST(sum(days_between) OVER (PARTITION BY k ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS INT)
        AS days_from_first FROM seq),
    wk AS (SELECT *, CAST(ceil(days_from_first / 7.0) AS INT) AS weeks_from_first, {BINS} AS day_group FROM run)
    SELECT k AS user_id, id AS event_id, ts, name AS event_type, days_between, days_from_first, day_group,
        count(*) OVER (PARTITION BY days_from_first) AS n_per_day, weeks_from_first,
        count(*) OVER (PARTITION BY weeks_from_first) AS n_per_week, session_number, {extra} FROM wk"""


def base(c: str) -> str:
    first = f"first_value({c}) OVER (PARTITION BY k ORDER BY ts, id)"
    return f"(CASE WHEN {first} IS NULL THEN NULL WHEN size_ > 1 THEN greatest({first}, 0) ELSE {first} END)"


@query(
    "trajectory_multi",
    trajectory_sql(
        """SELECT user_id AS k, ts, event_id AS id, event_type AS name, value AS pain,
             nullif(CAST(floor(value) AS INT) % 6, 5) AS stress FROM events
           WHERE event_type IN ('view', 'click', 'signup') AND user_id IN
             (SELECT user_id FROM events WHERE event_type = 'signup')""",
        f"""pain, stress, round(pain - {base('pain')}, 6) AS pain_bdiff, stress - {base('stress')} AS stress_bdiff,
            round((pain - {base('pain')}) / nullif({base('pain')}, 0), 6) AS pain_pctdiff""",
    ),
)
def _(s, d):
    e = table(s, d, "events").select(
        "user_id", "ts", "event_id", "event_type", F.col("value").alias("pain"),
        F.nullif(F.floor("value").cast("int") % 6, F.lit(5)).alias("stress"),
    )
    out = op.trajectory_multi(
        e, "user_id", "ts", ["pain", "stress"], ["view", "click", "signup"], ["signup"], name="event_type",
        tie="event_id", pct=["pain"],
    )
    return rounded(out, "pain_bdiff", "pain_pctdiff")


@query(
    "trajectory_score",
    trajectory_sql(
        """SELECT *, q1 + q2 + q3 AS score FROM (SELECT user_id AS k, ts, event_id AS id, event_type AS name,
             nullif(CAST(floor(value) AS INT) % 5, 4) AS q1, nullif(CAST(floor(value) AS INT) % 7, 6) AS q2,
             nullif(CAST(floor(value) AS INT) % 3, 2) AS q3 FROM events
           WHERE event_type IN ('view', 'purchase') AND user_id IN
             (SELECT user_id FROM events WHERE event_type = 'purchase'))
           WHERE q1 IS NOT NULL AND q2 IS NOT NULL AND q3 IS NOT NULL""",
        f"""score, 3 AS n_answered, score - lag(score) OVER (PARTITION BY k ORDER BY ts, id) AS score_change,
            score - {base('score')} AS score_bdiff""",
    ),
)
def _(s, d):
    v = F.floor("value").cast("int")
    e = table(s, d, "events").select(
        "user_id", "ts", "event_id", "event_type",
        *[F.nullif(v % m, F.lit(m - 1)).alias(q) for q, m in (("q1", 5), ("q2", 7), ("q3", 3))],
    )
    return op.trajectory_score(
        e, "user_id", "ts", ["q1", "q2", "q3"], ["view", "purchase"], ["purchase"], name="event_type", tie="event_id"
    )


# --- trends --------------------------------------------------------------------------

# Prices in whole cents: sums are exact, so means agree to the last bit.
WEEKLY = """(SELECT CAST(ceil(date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate) / 7.0) AS INT)
  AS week, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS price, CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.0 END
  AS closed FROM orders)"""


def weeks_since_first(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    o = op.running_days(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate", "days")
    status = F.col("o_orderstatus")
    return o.select(
        F.ceil(F.col("days") / 7).cast("int").alias("week"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("double").alias("price"),
        F.when(status == "F", 1.0).when(status == "O", 0.0).alias("closed"),
    )


@query(
    "weekly_mean",
    f"""SELECT measure, week, avg(v) AS mean, count(v) AS n, count(*) AS n_rows FROM
        (SELECT week, 'price' AS measure, price AS v FROM {WEEKLY} UNION ALL
         SELECT week, 'closed', CAST(closed AS DOUBLE) FROM {WEEKLY}) GROUP BY 1, 2""",
)
def _(s, d):
    return op.weekly_mean(weeks_since_first(s, d), "week", ["price", "closed"])


@query(
    "nearest_point",
    f"""WITH m AS (SELECT week, avg(price) AS y FROM {WEEKLY} GROUP BY 1), t AS (SELECT unnest([0.0, 4.4, 8.5]) AS target)
        SELECT CAST(target AS DOUBLE) AS target, arg_min(y, abs(week - target) * 1000000 + week) AS mean
        FROM m, t GROUP BY 1""",
)
def _(s, d):
    means = op.weekly_mean(weeks_since_first(s, d), "week", ["price"])
    return op.nearest_point(means, "week", "mean", [0, 4.4, 8.5])


@query(
    "pct_change_points",
    f"""WITH m AS (SELECT week, avg(price) AS y FROM {WEEKLY} GROUP BY 1),
        s AS (SELECT arg_min(y, week) AS y0 FROM m)
        SELECT y0 AS start_value, CAST(week AS DOUBLE) AS target, y AS value,
               (y - y0) / nullif(y0, 0) * 100 AS pct_change FROM m, s WHERE week IN (4, 8)""",
)
def _(s, d):
    means = op.weekly_mean(weeks_since_first(s, d), "week", ["price"])
    return op.pct_change_points(means, "week", "mean", 0, [4, 8])


@query(
    "local_trend",
    f"""
    WITH p AS (SELECT CAST(week AS DOUBLE) AS x, count(*) AS n, sum(price) AS sy FROM {WEEKLY} GROUP BY 1),
    b AS (SELECT min(x) AS lo, max(x) AS hi, sum(n) AS total, count(*) AS weeks FROM p),
    g AS (SELECT i, lo + (hi - lo) * i / 79.0 AS x0, total, weeks FROM b, (SELECT unnest(range(80)) AS i)),
    d AS (SELECT g.*, x, n, sy, abs(x - x0) AS d, sum(n) OVER (PARTITION BY i ORDER BY abs(x - x0), x) AS within FROM g, p),
    h AS (SELECT *, min(d) FILTER (within >= floor(total * 0.75 + 1e-5)) OVER (PARTITION BY i) AS h FROM d),
    w AS (SELECT i, x0, n, sy, (x - x0) / h AS u, CASE WHEN d < h THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w FROM h),
    m AS (SELECT i, x0, sum(w * n) AS a, sum(w * n * u) AS b, sum(w * n * u * u) AS c, sum(w * n * pow(u, 3)) AS d,
            sum(w * n * pow(u, 4)) AS e, sum(w * sy) AS p, sum(w * sy * u) AS q, sum(w * sy * u * u) AS r FROM w GROUP BY 1, 2)
    SELECT i::INT AS grid_index, round(x0, 4) AS week,
      round((p * (c * e - d * d) + q * (c * d - b * e) + r * (b * d - c * c))
          / (a * (c * e - d * d) + b * (c * d - b * e) + c * (b * d - c * c)), 4) AS price FROM m""",
)
def _(s, d):
    curve = op.local_trend(weeks_since_first(s, d), "week", "price")
    return rounded(curve, "week", "price", places=4)


@query(
    "local_trend_band",
    f"""
    WITH p AS (SELECT CAST(week AS DOUBLE) AS x, count(*) AS n, sum(price) AS sy, sum(price * price) AS syy FROM {WEEKLY} GROUP BY 1),
    b AS (SELECT min(x) AS lo, max(x) AS hi, sum(n) AS total FROM p),
    g AS (SELECT 'grid' AS kind, CAST(i AS DOUBLE) AS i, lo + (hi - lo) * i / 79.0 AS x0, total FROM b, (SELECT unnest(range(80)) AS i)
      UNION ALL SELECT 'week', x, x, total FROM p, b),
    d AS (SELECT g.*, x, n, sy, abs(x - x0) AS d, sum(n) OVER (PARTITION BY kind, i ORDER BY abs(x - x0), x) AS within FROM g, p),
    h AS (SELECT *, min(d) FILTER (within >= floor(total * 0.75 + 1e-5)) OVER (PARTITION BY kind, i) AS h FROM d),
    w AS (SELECT *, (x - x0) / h AS u, CASE WHEN d < h THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w FROM h),
    m AS (SELECT kind, i, sum(w * n) AS a, sum(w * n * u) AS b, sum(w * n * u * u) AS c, sum(w * n * pow(u, 3)) AS d3, sum(w * n * pow(u, 4)) AS e
      FROM w GROUP BY 1, 2),
    l AS (SELECT w.kind, w.i, x0, x, n, sy, w * ((c * e - d3 * d3) + (c * d3 - b * e) * u + (b * d3 - c * c) * u * u)
        / (a * (c * e - d3 * d3) + b * (c * d3 - b * e) + c * (b * d3 - c * c)) AS l FROM w JOIN m ON m.kind = w.kind AND m.i = w.i),
    f AS (SELECT kind, i, x0, sum(l * sy) AS fit, sum(n * l * l) AS norm, max(l) FILTER (x = x0) AS own FROM l GROUP BY 1, 2, 3),
    v AS (SELECT sum(syy - 2 * fit * sy + n * fit * fit) / (sum(n) - 2 * sum(n * own) + sum(n * norm)) AS v FROM f JOIN p ON p.x = f.x0 WHERE kind = 'week')
    SELECT CAST(i AS INT) AS grid_index, round(x0, 4) AS week, round(fit / 100, 2) AS price, round(sqrt(v * norm) / 100, 2) AS se FROM f, v WHERE kind = 'grid'""",
)
def _(s, d):
    band = op.local_trend(weeks_since_first(s, d), "week", "price", se=True)
    band = band.withColumns({"price": F.col("price") / 100, "se": F.col("se") / 100})
    return rounded(rounded(band, "week", places=4), "price", "se", places=2)


@query(
    "spline_trend",
    f"""
    WITH RECURSIVE p AS (SELECT CAST(week AS DOUBLE) AS x, count(*) AS n, sum(price) AS sy, sum(price * price) AS syy FROM {WEEKLY} GROUP BY 1),
    b AS (SELECT min(x) AS lo, max(x) AS hi, sum(n) AS total, sum(sy) / sum(n) AS mean FROM p),
    left_over AS (SELECT sum(syy - 2 * mean * sy + n * mean * mean) AS ss FROM p, b),
    places AS (SELECT 'week' AS kind, x AS spot, (x - lo) / (hi - lo) * 10 AS s, n, sy - n * mean AS rest FROM p, b
      UNION ALL SELECT 'grid', CAST(i AS DOUBLE), i / 79.0 * 10, 0, 0 FROM (SELECT unnest(range(80)) AS i)),
    u AS (SELECT *, least(CAST(floor(s) AS INT), 9) AS seg, s - least(CAST(floor(s) AS INT), 9) AS u FROM places),
    v AS (SELECT kind, spot, n, rest, seg + k AS i, CASE k WHEN 0 THEN pow(1 - u, 3) / 6 WHEN 1 THEN (3 * pow(u, 3) - 6 * u * u + 4) / 6
        WHEN 2 THEN (-3 * pow(u, 3) + 3 * u * u + 3 * u + 1) / 6 ELSE pow(u, 3) / 6 END AS v FROM u, (SELECT unnest(range(4)) AS k)),
    gram AS (SELECT a.i, b.i AS j, sum(a.n * a.v * b.v) AS g FROM v a JOIN v b ON a.spot = b.spot WHERE a.kind = 'week' AND b.kind = 'week' GROUP BY 1, 2),
    side AS (SELECT i, sum(rest * v) AS r FROM v WHERE kind = 'week' GROUP BY 1),
    d2 AS (SELECT p, p + k AS i, CASE k WHEN 1 THEN -2.0 ELSE 1.0 END AS v FROM (SELECT unnest(range(11)) AS p), (SELECT unnest(range(3)) AS k)),
    bend AS (SELECT a.i, b.i AS j, sum(a.v * b.v * CASE WHEN a.p <> b.p THEN 1.0 / 6 WHEN a.p IN (0, 10) THEN 1.0 / 3 ELSE 2.0 / 3 END) AS w
      FROM d2 a JOIN d2 b ON abs(a.p - b.p) <= 1 GROUP BY 1, 2),
    pens AS (SELECT k / 4.0 AS power, pow(10, k / 4.0) * (SELECT sum(g) FROM gram WHERE i = j) / (SELECT sum(w) FROM bend WHERE i = j) AS pen
      FROM (SELECT unnest(range(-24, 25)) AS k)),
    cells AS (SELECT i, j FROM (SELECT unnest(range(13)) AS i), (SELECT unnest(range(27)) AS j)),
    solve AS (
      SELECT 0 AS k, power, pen, c.i, c.j, CAST(CASE WHEN c.j < 13 THEN coalesce(g, 0) + pen * coalesce(w, 0) WHEN c.j = 13 THEN coalesce(r, 0)
          WHEN c.j = 14 + c.i THEN 1 ELSE 0 END AS DOUBLE) AS v
      FROM pens, cells c LEFT JOIN gram ON gram.i = c.i AND gram.j = c.j LEFT JOIN bend ON bend.i = c.i AND bend.j = c.j LEFT JOIN side ON side.i = c.i
      UNION ALL
      SELECT t.k + 1, t.power, t.pen, t.i, t.j, CASE WHEN t.i = t.k THEN t.v / p.v ELSE t.v - c.v * r.v / p.v END
      FROM solve t JOIN solve p ON p.power = t.power AND p.i = t.k AND p.j = t.k JOIN solve c ON c.power = t.power AND c.i = t.i AND c.j = t.k
      JOIN solve r ON r.power = t.power AND r.i = t.k AND r.j = t.j WHERE t.k < 13),
    pivots AS (SELECT power, sum(ln(v)) AS log_det FROM solve WHERE i = k AND j = k GROUP BY 1),
    done AS (SELECT power, pen, ss - sum(v * coalesce(r, 0)) AS rest FROM solve LEFT JOIN side USING (i), left_over WHERE k = 13 AND j = 13 GROUP BY 1, 2, ss),
    best AS (SELECT power, rest FROM done JOIN pivots USING (power), b ORDER BY (total - 2) * ln(rest) + log_det - 11 * ln(pen), power DESC LIMIT 1),
    coef AS (SELECT i, j, v FROM solve WHERE k = 13 AND j >= 13 AND power = (SELECT power FROM best)),
    fit AS (SELECT spot, sum(v.v * coef.v) AS fit FROM v JOIN coef ON coef.i = v.i AND coef.j = 13 WHERE kind = 'grid' GROUP BY 1),
    spread AS (SELECT a.spot, sum(a.v * coef.v * b.v) AS w FROM v a JOIN v b ON a.spot = b.spot AND b.kind = 'grid' JOIN coef ON coef.i = a.i AND coef.j = 14 + b.i
      WHERE a.kind = 'grid' GROUP BY 1)
    SELECT CAST(spot AS INT) AS grid_index, round(lo + (hi - lo) * spot / 79.0, 4) AS week, round((mean + fit) / 100, 2) AS price,
      round(sqrt(rest / (total - 2) * w) / 100, 2) AS se FROM fit JOIN spread USING (spot), b, best""",
)
def _(s, d):
    curve = op.local_trend(weeks_since_first(s, d), "week", "price", se=True, method="spline")
    curve = curve.withColumns({"price": F.col("price") / 100, "se": F.col("se") / 100})
    return rounded(rounded(curve, "week", places=4), "price", "se", places=2)
