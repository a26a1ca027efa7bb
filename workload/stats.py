"""Frequency tables, cross-tabs, descriptives and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom import operators as op
from workload.registry import query, rounded, table

PCT = ("pct_valid", "cum_valid", "pct_total", "cum_total")


def freq_sql(source: str, columns: dict[str, str], shown: bool) -> str:
    """Frequency tables written with plain window functions."""
    long = " UNION ALL ".join(f"SELECT '{n}' AS variable, CAST({e} AS VARCHAR) AS value FROM {source}" for n, e in columns.items())
    lead = "variable, " if shown else ""
    return f"""
    WITH c AS (SELECT variable, value, count(*) AS n FROM ({long}) GROUP BY 1, 2),
    t AS (SELECT variable, CAST(sum(n) AS BIGINT) AS total,
                 CAST(coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS BIGINT) AS valid FROM c GROUP BY 1),
    v AS (SELECT c.*, t.total, t.valid, sum(n) OVER (PARTITION BY variable
            ORDER BY TRY_CAST(value AS DOUBLE) NULLS LAST, value) AS cum FROM c JOIN t USING (variable)
          WHERE value IS NOT NULL)
    SELECT {lead}'value' AS kind, value, n, round(n * 100.0::DOUBLE / valid, 6) AS pct_valid,
           round(cum * 100.0::DOUBLE / valid, 6) AS cum_valid, round(n * 100.0::DOUBLE / total, 6) AS pct_total,
           round(cum * 100.0::DOUBLE / total, 6) AS cum_total FROM v
    UNION ALL SELECT {lead}'missing', NULL, total - valid, NULL, NULL,
           round((total - valid) * 100.0::DOUBLE / total, 6), 100.0 FROM t
    UNION ALL SELECT {lead}'total', NULL, total, 100.0, 100.0, 100.0, 100.0 FROM t"""


@query("freq", freq_sql("orders", {"priority": "nullif(o_orderpriority, '5-LOW')"}, False))
def _(s, d):
    o = table(s, d, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return rounded(op.freq(o, "priority"), *PCT)


@query(
    "freq_multi",
    freq_sql(
        "lineitem",
        {"flag": "nullif(l_returnflag, 'N')", "status": "l_linestatus", "line": "l_linenumber", "part": "l_partkey"},
        True,
    ),
)
def _(s, d):
    li = table(s, d, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )
    return rounded(op.freq_multi(li, ["flag", "status", "line", "part"]), *PCT)


SUBSET = "(SELECT CASE WHEN c THEN o_orderpriority END AS p FROM (SELECT *, nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000 AS c FROM orders) WHERE c OR c IS NULL)"


@query("na_subset_freq", freq_sql(SUBSET, {"p": "p"}, False))
def _(s, d):
    cond = (F.nullif("o_orderstatus", F.lit("P")) == "F") & (F.col("o_totalprice") > 100000)
    return rounded(op.na_subset_freq(table(s, d, "orders"), "o_orderpriority", cond), *PCT)


def crosstab_sql(source: str) -> str:
    return f"""
    WITH c AS (SELECT r, k, count(*) AS n FROM {source} GROUP BY 1, 2),
    g AS (SELECT r, k, CAST(sum(n) AS BIGINT) AS n, grouping(r) AS gr, grouping(k) AS gk FROM c
          GROUP BY GROUPING SETS ((r, k), (r), (k), ()))
    SELECT a.r AS "row", a.k AS "col", a.n, round(a.n * 100.0::DOUBLE / b.n, 6) AS row_pct,
           CASE WHEN a.gr = 0 AND a.gk = 0 THEN 'cell' WHEN a.gr = 0 THEN 'row_total'
                WHEN a.gk = 0 THEN 'col_total' ELSE 'grand_total' END AS margin
    FROM g a JOIN g b ON b.gk = 1 AND a.gr = b.gr AND a.r IS NOT DISTINCT FROM b.r"""


@query(
    "crosstab",
    crosstab_sql("(SELECT o_orderstatus AS r, nullif(o_orderpriority, '5-LOW') AS k FROM orders)"),
)
def _(s, d):
    o = table(s, d, "orders").select(
        F.col("o_orderstatus").alias("row"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("col")
    )
    return rounded(op.crosstab(o, "row", "col"), "row_pct")


@query(
    "crosstab_subset",
    crosstab_sql(
        "(SELECT CASE WHEN c THEN o_orderstatus END AS r, CASE WHEN c THEN o_orderpriority END AS k FROM "
        "(SELECT *, nullif(o_orderpriority, '5-LOW') <> '1-URGENT' AS c FROM orders) WHERE c OR c IS NULL)"
    ),
)
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("row"), F.col("o_orderpriority").alias("col"))
    cond = F.nullif("col", F.lit("5-LOW")) != "1-URGENT"
    return rounded(op.crosstab_subset(o, "row", "col", cond), "row_pct")


def describe_sql(source: str, cols: list[str]) -> str:
    def one(c):
        return f"""
        SELECT '{c}' AS variable, count({c}) AS n_valid, round(count({c}) * 100.0 / count(*), 6) AS pct_valid,
          round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std_dev, min({c})::DOUBLE AS min,
          max({c})::DOUBLE AS max, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median,
          round(quantile_cont({c}, 0.75), 4) AS q3,
          round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
          round(stddev_samp({c}) / avg({c}), 4) AS cv,
          round((SELECT 1.4826 * median(abs(x.v - m.m)) FROM (SELECT {c} AS v FROM {source}) x,
             (SELECT median({c}) AS m FROM {source}) m), 4) AS mad,
          round((SELECT avg(pow(x.v - m.m, 3)) / pow(avg(pow(x.v - m.m, 2)), 1.5) FROM (SELECT {c} AS v FROM {source}) x,
             (SELECT avg({c}) AS m FROM {source}) m), 4) AS skewness,
          round((SELECT avg(pow(x.v - m.m, 4)) / pow(avg(pow(x.v - m.m, 2)), 2) - 3 FROM (SELECT {c} AS v FROM {source}) x,
             (SELECT avg({c}) AS m FROM {source}) m), 4) AS kurtosis
        FROM {source}"""

    return " UNION ALL ".join(one(c) for c in cols)


@query(
    "describe_numeric",
    describe_sql("(SELECT value, CAST(nullif(user_id, 5) AS DOUBLE) AS who FROM events)", ["value", "who"]),
)
def _(s, d):
    e = table(s, d, "events").select("value", F.nullif("user_id", F.lit(5)).cast("double").alias("who"))
    out = op.describe_numeric(e, ["value", "who"])
    fours = ["mean", "std_dev", "q1", "median", "q3", "iqr", "cv", "mad", "skewness", "kurtosis"]
    return rounded(rounded(out, *fours, places=4), "pct_valid")


def profile_sql(source: str, types: dict[str, str], top: int) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value FROM {source}" for c in types)
    kinds = " UNION ALL ".join(f"SELECT '{c}' AS variable, '{t}' AS type" for c, t in types.items())
    numeric = ", ".join(f"'{c}'" for c, t in types.items() if t in ("bigint", "int", "double"))
    return f"""
    WITH c AS (SELECT variable, value, count(*) AS n FROM ({long}) GROUP BY 1, 2),
    x AS (SELECT *, CASE WHEN variable IN ({numeric}) THEN TRY_CAST(value AS DOUBLE) END AS v FROM c),
    s AS (SELECT variable, CAST(coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS BIGINT) AS n_valid,
            CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS n_missing, count(value) AS n_distinct,
            min(v) AS min, max(v) AS max, round(sum(v * n) / sum(n) FILTER (v IS NOT NULL), 4) AS mean FROM x GROUP BY 1),
    r AS (SELECT variable, value, n AS value_n, CAST(row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS INT)
            AS rank FROM c WHERE value IS NOT NULL)
    SELECT s.*, k.type, r.value, r.value_n, r.rank, r.n_values FROM s JOIN ({kinds}) k USING (variable)
    LEFT JOIN (SELECT *, CAST(1 AS BIGINT) AS n_values FROM r WHERE rank <= {top}
      UNION ALL SELECT variable, NULL, CAST(sum(value_n) AS BIGINT), NULL, count(*) FROM r WHERE rank > {top} GROUP BY 1) r
      USING (variable)"""


@query(
    "profile_table",
    profile_sql(
        "(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, o_totalprice, o_orderdate, "
        "o_orderpriority FROM orders)",
        {"o_orderkey": "bigint", "o_custkey": "bigint", "status": "string", "o_totalprice": "double",
         "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
        5,
    ),
)
def _(s, d):
    o = table(s, d, "orders").select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice",
        "o_orderdate", "o_orderpriority",
    )
    return rounded(op.profile_table(o, 5), "mean", places=4)


@query(
    "multi_flag_means",
    """SELECT variable, round(mean, 6) AS mean FROM (
       SELECT 'red' AS variable, avg(CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END) AS mean FROM part
       UNION ALL SELECT 'ring', avg(CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END) FROM part
       UNION ALL SELECT 'large', CAST(NULL AS DOUBLE))""",
)
def _(s, d):
    p = table(s, d, "part").select(
        *[F.contains("p_name", F.lit(t)).cast("int").alias(t) for t in ("red", "ring")],
        F.nullif((F.col("p_size") > 25).cast("int"), F.lit(1)).alias("large"),
    )
    return rounded(op.multi_flag_means(p, ["red", "ring", "large"], na="propagate"), "mean")


@query(
    "numeric_totals",
    """SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice,
       round(sum(l_tax), 2) AS l_tax, CAST(sum(nullif(l_linenumber, 7)) AS BIGINT) AS line FROM lineitem""",
)
def _(s, d):
    li = table(s, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_tax", F.nullif("l_linenumber", F.lit(7)).alias("line"), "l_returnflag"
    )
    return rounded(op.numeric_totals(li), "l_quantity", "l_extendedprice", "l_tax", places=2)


@query("distinct_keys", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    return op.distinct_keys(table(s, d, "orders").filter("o_orderstatus = 'F'"), "o_custkey")


ITEMS = ["a", "b", "c", "d"]


@query(
    "completeness_score",
    """SELECT p_partkey, n AS plan_n, CASE WHEN n >= 3 THEN 1 ELSE 0 END AS plan_enough,
       CASE WHEN n = 4 THEN a + b + c + d END AS plan_sum FROM
       (SELECT *, (CASE WHEN a IS NULL THEN 0 ELSE 1 END) + (CASE WHEN b IS NULL THEN 0 ELSE 1 END)
          + (CASE WHEN c IS NULL THEN 0 ELSE 1 END) + (CASE WHEN d IS NULL THEN 0 ELSE 1 END) AS n FROM
        (SELECT p_partkey, nullif(p_size % 3, 0) AS a, nullif(p_size % 5, 0) AS b, nullif(p_size % 7, 0) AS c,
                nullif(p_size % 11, 0) AS d FROM part))""",
)
def _(s, d):
    mods = dict(zip(ITEMS, (3, 5, 7, 11), strict=True))
    p = table(s, d, "part").select(
        "p_partkey", *[F.nullif(F.col("p_size") % m, F.lit(0)).alias(c) for c, m in mods.items()]
    )
    return op.completeness_score(p, ITEMS, 3, "plan").drop(*ITEMS)


@query(
    "nps_score",
    """SELECT p_brand, count(x) AS n_answered, CAST(sum(pro) AS BIGINT) AS promoters, CAST(sum(det) AS BIGINT) AS detractors,
       avg(pro) AS promoter_share, avg(det) AS detractor_share, (avg(pro) - avg(det)) * 100 AS nps FROM
       (SELECT p_brand, x, CASE WHEN x IN (9, 10) THEN 1 WHEN x IS NOT NULL THEN 0 END AS pro,
               CASE WHEN x BETWEEN 1 AND 6 THEN 1 WHEN x IS NOT NULL THEN 0 END AS det
        FROM (SELECT p_brand, nullif(p_size % 11, 5) AS x FROM part)) GROUP BY 1""",
)
def _(s, d):
    p = table(s, d, "part").select("p_brand", F.nullif(F.col("p_size") % 11, F.lit(5)).alias("x"))
    return op.nps_score(p, "x", "p_brand")


@query(
    "chi_square",
    """
    WITH c AS (SELECT t, r, k, count(*) AS o FROM (
        SELECT 'priority' AS t, o_orderpriority AS r, o_orderstatus AS k FROM orders
        UNION ALL SELECT 'two_by_two', o_orderpriority, o_orderstatus FROM orders
          WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')) GROUP BY 1, 2, 3),
    rr AS (SELECT t, r, sum(o) AS n FROM c GROUP BY 1, 2), kk AS (SELECT t, k, sum(o) AS n FROM c GROUP BY 1, 2),
    tt AS (SELECT t, sum(o) AS n FROM c GROUP BY 1),
    e AS (SELECT rr.t, coalesce(c.o, 0) AS o, rr.n * kk.n / tt.n::DOUBLE AS e, tt.n AS n,
            (SELECT count(*) FROM rr x WHERE x.t = rr.t) AS nr, (SELECT count(*) FROM kk x WHERE x.t = rr.t) AS nk
          FROM rr JOIN kk ON rr.t = kk.t JOIN tt ON tt.t = rr.t
          LEFT JOIN c ON c.t = rr.t AND c.r = rr.r AND c.k = kk.k),
    y AS (SELECT *, CASE WHEN nr = 2 AND nk = 2 THEN least(0.5, min(abs(o - e)) OVER (PARTITION BY t)) ELSE 0 END AS y FROM e),
    z AS (SELECT t AS stratum, CAST(min(n) AS BIGINT) AS n, sum(pow(abs(o - e) - y, 2) / e) AS stat,
           CAST(min((nr - 1) * (nk - 1)) AS BIGINT) AS dof FROM y GROUP BY 1)
    SELECT stratum, n, round(stat, 6) AS stat, dof, round(1 - sum(exp((dof / 2.0::DOUBLE + i) * ln(stat / 2) - stat / 2 - lgamma(dof / 2.0::DOUBLE + i + 1))), 6) AS p
    FROM z, (SELECT unnest(range(400)) AS i) GROUP BY stratum, n, z.stat, dof""",
)
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("r"), F.col("o_orderstatus").alias("k"))
    two = F.col("r").isin("1-URGENT", "2-HIGH") & F.col("k").isin("F", "O")
    strata = F.when(two, F.array(F.lit("priority"), F.lit("two_by_two"))).otherwise(F.array(F.lit("priority")))
    out = op.chi_square(o.withColumn("stratum", F.explode(strata)), "r", "k", by=["stratum"])
    return rounded(out, "stat", "p")


@query(
    "fisher_exact",
    """
    WITH x AS (SELECT lang, quality AS r, toxic AS k FROM labels JOIN documents USING (doc_id)),
    m AS (SELECT lang, count(*) AS n, count(*) FILTER (r = 0) AS r0, count(*) FILTER (k = 0) AS k0,
                 count(*) FILTER (r = 0 AND k = 0) AS a, count(DISTINCT r) AS nr, count(DISTINCT k) AS nk FROM x GROUP BY 1),
    h AS (SELECT m.*, i, lgamma(r0 + 1) - lgamma(i + 1) - lgamma(r0 - i + 1)
            + lgamma(n - r0 + 1) - lgamma(k0 - i + 1) - lgamma(n - r0 - k0 + i + 1)
            - lgamma(n + 1) + lgamma(k0 + 1) + lgamma(n - k0 + 1) AS lp
          FROM m, LATERAL (SELECT unnest(range(greatest(0, k0 + r0 - n), least(r0, k0) + 1)) AS i) WHERE nr = 2 AND nk = 2)
    SELECT lang, n, round(least(1.0, (SELECT sum(exp(lp)) FROM h g WHERE g.lang = h.lang
             AND exp(g.lp) <= exp(h.lp) * (1 + 1e-7))), 6) AS p, 'exact' AS method
    FROM h WHERE i = a
    UNION ALL SELECT lang, n, NULL, 'none' FROM m WHERE NOT (nr = 2 AND nk = 2)""",
)
def _(s, d):
    x = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(op.fisher_exact(x, "quality", "toxic", by=["lang"]), "p")
