"""Scans, projections, filters, joins and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom import functions as fn
from cohortloom import operators as op
from cohortloom import params as P
from cohortloom import sources as src
from workload.mapping import view, with_ctes
from workload.registry import query, table

SEVEN = ("wished_you_were_dead_past_month", "thoughts_of_killing_yourself_past_month",
         "done_started_prepared_to_end_your_life")


@query("scan_project", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def _(s, d):
    return src.scan_project(s, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])


@query(
    "time_window",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' "
    "AND o_orderdate < TIMESTAMP '1998-01-01'",
)
def _(s, d):
    return src.time_window(table(s, d, "orders"), "o_orderdate", "1997-01-01", "1998-01-01").select(
        "o_orderkey", "o_orderdate"
    )


@query("type_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'purchase')")
def _(s, d):
    return src.type_filter(table(s, d, "events"), "event_type", ["view", "purchase"]).select("event_id", "event_type")


@query(
    "null_or_ne",
    "SELECT * FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders) "
    "WHERE priority IS NULL OR priority <> '1-URGENT'",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return o.filter(src.null_or_ne(F.col("priority"), "1-URGENT"))


@query(
    "key_semi_join",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-01')",
)
def _(s, d):
    recent = src.time_window(table(s, d, "orders"), "o_orderdate", "1997-01-01", "1997-03-01")
    return src.key_semi_join(table(s, d, "customer"), "c_custkey", recent, "o_custkey").select(
        "c_custkey", "c_mktsegment"
    )


@query("project", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(s, d):
    return op.project(
        table(s, d, "orders"), keep=["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"], drop=["o_orderdate"]
    )


@query(
    "rename_labels",
    'SELECT o_orderkey AS "Order number", o_orderdate AS "When was it placed?", o_orderstatus AS "Status - now" '
    "FROM orders",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return op.rename_labels(
        o,
        {"o_orderkey": "Order number", "o_orderdate": "When was it placed?", "o_orderstatus": "Status - now"},
    )


@query(
    "derive_chain",
    """SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month_created,
       CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 1 ELSE 0 END AS winter,
       CASE WHEN month(o_orderdate) IN (12, 1, 2) OR o_orderstatus = 'F' THEN 1 ELSE 0 END AS winter_or_closed
       FROM orders""",
)
def _(s, d):
    return op.derive_chain(
        table(s, d, "orders"),
        [
            ("month_created", F.month("o_orderdate")),
            ("winter", fn.flag(F.col("month_created").isin(12, 1, 2))),
            ("winter_or_closed", fn.flag((F.col("winter") == 1) | (F.col("o_orderstatus") == "F"))),
        ],
    ).select("o_orderkey", "month_created", "winter", "winter_or_closed")


@query(
    "recode_value",
    """SELECT o_orderkey, CASE WHEN p = '1-URGENT' THEN '2-HIGH' WHEN p IS NULL AND o_orderstatus = 'F'
       THEN 'closed' ELSE p END AS priority
       FROM (SELECT *, nullif(o_orderpriority, '5-LOW') AS p FROM orders)""",
)
def _(s, d):
    o = table(s, d, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    rules = [
        (F.col("p") == "1-URGENT", "2-HIGH"),
        (F.col("p").isNull() & (F.col("o_orderstatus") == "F"), "closed"),
    ]
    return o.select("o_orderkey", fn.recode_value(F.col("p"), rules).alias("priority"))


@query(
    "relabel",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '1. HRC' WHEN '2-HIGH' THEN '2. MRC'
       WHEN '3-MEDIUM' THEN '3. LRC' END AS risk FROM orders""",
)
def _(s, d):
    labels = dict(zip(("1-URGENT", "2-HIGH", "3-MEDIUM"), P.RISK_LABELS.values(), strict=True))
    return table(s, d, "orders").select("o_orderkey", fn.relabel(F.col("o_orderpriority"), labels).alias("risk"))


@query(
    "coalesce_levels",
    """SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), nullif(o_orderstatus, 'P'), 'none') AS level
       FROM orders""",
)
def _(s, d):
    first = F.nullif("o_orderpriority", F.lit("5-LOW"))
    second = F.nullif("o_orderstatus", F.lit("P"))
    return table(s, d, "orders").select(
        "o_orderkey", fn.coalesce_levels(first, second, F.lit("none")).alias("level")
    )


@query(
    "rowwise_extremes",
    """SELECT p_partkey, greatest(nullif(p_size, 7), nullif(p_size % 11, 0), CAST(p_partkey % 13 AS INT)) AS largest,
       least(nullif(p_size, 7), nullif(p_size % 11, 0), CAST(p_partkey % 13 AS INT)) AS smallest FROM part""",
)
def _(s, d):
    cols = [
        F.nullif("p_size", F.lit(7)), F.nullif(F.col("p_size") % 11, F.lit(0)),
        (F.col("p_partkey") % 13).cast("int"),
    ]
    return table(s, d, "part").select(
        "p_partkey", fn.rowwise_extremes(cols, "max").alias("largest"), fn.rowwise_extremes(cols, "min").alias("smallest")
    )


# --- filters -------------------------------------------------------------------


@query(
    "conj_filter",
    """SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') <> '1-URGENT' AND o_totalprice > 100000
       AND o_orderstatus = 'F'""",
)
def _(s, d):
    p = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return op.conj_filter(
        table(s, d, "orders"), p != "1-URGENT", F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F"
    ).select("o_orderkey")


@query(
    "exclude_list",
    """SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
       WHERE p IS NULL OR p NOT IN ('1-URGENT', '2-HIGH')""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return op.exclude_list(o, "p", ["1-URGENT", "2-HIGH"])


@query(
    "exclude_list_status",
    """SELECT o_orderkey, p, o_orderstatus FROM
       (SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
       WHERE (p IS NULL AND o_orderstatus = 'O') OR p NOT IN ('1-URGENT', '2-HIGH')""",
)
def _(s, d):
    o = table(s, d, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"), "o_orderstatus"
    )
    return op.exclude_list_status(o, "p", ["1-URGENT", "2-HIGH"], "o_orderstatus", "O")


@query(
    "drop_test_names",
    """SELECT p_partkey, n FROM (SELECT p_partkey, nullif(p_name, 'red ring') AS n, p_size > 45 AS t FROM part)
       WHERE (n IS NULL OR (NOT contains(upper(n), 'BOLT') AND NOT contains(upper(n), 'GEAR'))) AND NOT t""",
)
def _(s, d):
    p = table(s, d, "part").select(
        "p_partkey", F.nullif("p_name", F.lit("red ring")).alias("n"), (F.col("p_size") > 45).alias("t")
    )
    return op.drop_test_names(p, "n", ["BOLT", "GEAR"], "t").select("p_partkey", "n")


# --- joins ---------------------------------------------------------------------


@query(
    "inner_join",
    "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return op.inner_join(table(s, d, "orders"), c, "o_custkey").select("o_orderkey", "c_mktsegment", "o_totalprice")


@query(
    "left_join_fill",
    """SELECT o_orderkey, coalesce(n_lines, 0) AS n_lines, coalesce(n_returned, 0) AS n_returned FROM orders
       LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines,
                         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_returned
                  FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def _(s, d):
    lines = (
        table(s, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(fn.flag(F.col("l_returnflag") == "R")).alias("n_returned"))
    )
    return op.left_join_fill(
        table(s, d, "orders").select("o_orderkey"), lines, "o_orderkey", {"n_lines": 0, "n_returned": 0}
    )


@query(
    "null_safe_join",
    """SELECT c.c_custkey, c.k AS nation, n.n_name FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) c
       JOIN (SELECT nullif(n_nationkey, 3) AS k, n_name FROM nation) n ON c.k IS NOT DISTINCT FROM n.k""",
)
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    n = table(s, d, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("nation"), "n_name")
    return op.null_safe_join(c, n, "nation", "inner")


@query(
    "dim_join_exclude",
    """SELECT c_custkey, n_name AS owner_name FROM customer JOIN nation ON c_nationkey = n_nationkey
       WHERE n_name <> (SELECT min(n_name) FROM nation WHERE n_nationkey = 3)""",
)
def _(s, d):
    n = table(s, d, "nation")
    excluded = n.filter("n_nationkey = 3").agg(F.min("n_name")).scalar()
    dim = n.select(F.col("n_nationkey").alias("owner_id"), F.col("n_name").alias("owner_name"))
    c = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("owner_id"))
    return op.dim_join_exclude(c, dim, "owner_id", "owner_name", excluded).select("c_custkey", "owner_name")


@query(
    "note_detail_join",
    """SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, level FROM
       (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')
       JOIN (SELECT *, nullif(l_returnflag, 'N') AS level FROM lineitem) ON o_orderkey = l_orderkey
       WHERE level IS NOT NULL""",
)
def _(s, d):
    cohort = src.time_window(table(s, d, "orders"), "o_orderdate", "1997-01-01", "1998-01-01")
    notes = table(s, d, "lineitem").withColumns(
        {"o_orderkey": F.col("l_orderkey"), "level": F.nullif("l_returnflag", F.lit("N"))}
    )
    return op.note_detail_join(
        cohort, notes, "o_orderkey", ["o_orderkey", "o_custkey", "l_linenumber", "l_partkey", "level"], "level"
    )


@query(
    "call_text_join",
    """SELECT e.event_id, e.call_id, c.turn, md5(c.text) AS text_digest, CAST(length(c.text) AS INT) AS text_length
       FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS call_id FROM events) e
       JOIN conversations c ON e.call_id = c.conv_id""",
)
def _(s, d):
    notes = table(s, d, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("call_id")
    )
    joined = op.call_text_join(notes, table(s, d, "conversations"), "call_id", "conv_id")
    return joined.select(
        "event_id", "call_id", "turn", F.md5("text").alias("text_digest"), F.length("text").alias("text_length")
    )


# --- classifications -------------------------------------------------------------


@query(
    "screen_flag",
    with_ctes("cases")
    + " SELECT id, CASE WHEN "
    + " AND ".join(f"{c} IS NOT NULL" for c in SEVEN)
    + " THEN 1 ELSE 0 END AS screened FROM cases",
)
def _(s, d):
    return view(s, d, "cases").select("id", fn.screen_flag([F.col(c) for c in SEVEN]).alias("screened"))


@query(
    "tiered_risk",
    with_ctes("cases")
    + """ SELECT id, CASE
      WHEN wished_you_were_dead_past_month = 'No' AND thoughts_of_killing_yourself_past_month = 'No'
           AND done_started_prepared_to_end_your_life = 'No' THEN 0
      WHEN 'Yes' IN (coalesce(done_started_prepared_last_3_months, ''), coalesce(details_of_how_intend_to_carry_out, ''),
                     coalesce(thoughts_intention_of_acting_on_them, '')) THEN 3
      WHEN 'Yes' IN (coalesce(done_started_prepared_to_end_your_life, ''),
                     coalesce(thinking_about_how_you_might_do_this, '')) THEN 2
      WHEN 'Yes' IN (coalesce(wished_you_were_dead_past_month, ''),
                     coalesce(thoughts_of_killing_yourself_past_month, '')) THEN 1 END AS screen_risk FROM cases""",
)
def _(s, d):
    c = F.col
    risk = fn.tiered_risk(
        all_no=[c(x) for x in SEVEN],
        high=[c("done_started_prepared_last_3_months"), c("details_of_how_intend_to_carry_out"),
              c("thoughts_intention_of_acting_on_them")],
        moderate=[c("done_started_prepared_to_end_your_life"), c("thinking_about_how_you_might_do_this")],
        low=[c("wished_you_were_dead_past_month"), c("thoughts_of_killing_yourself_past_month")],
    )
    return view(s, d, "cases").select("id", risk.alias("screen_risk"))


@query(
    "one_hot_flags",
    """SELECT c_custkey, CAST(s = 'BUILDING' AS INT) AS building, CAST(s = 'MACHINERY' AS INT) AS machinery
       FROM (SELECT c_custkey, nullif(c_mktsegment, 'HOUSEHOLD') AS s FROM customer)""",
)
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("s"))
    return op.project(
        fn.one_hot_flags(c, "s", {"BUILDING": "building", "MACHINERY": "machinery"}),
        keep=["c_custkey", "building", "machinery"],
    )


@query(
    "bucket_unknown",
    with_ctes("accounts")
    + f""" SELECT id, CASE WHEN ethnicity IS NULL OR ethnicity IN ('Prefer Not to Say', 'Unknown') THEN '{P.UNKNOWN}'
       ELSE ethnicity END AS ethnicity_group,
       CASE WHEN health_cloud_ga_gender IN ('Man', 'Woman', 'Other') THEN health_cloud_ga_gender
       ELSE '{P.UNKNOWN}' END AS gender FROM accounts""",
)
def _(s, d):
    return view(s, d, "accounts").select(
        "id",
        fn.bucket_unknown(F.col("ethnicity"), refused=P.ETHNICITY_REFUSED, unknown=P.UNKNOWN).alias("ethnicity_group"),
        fn.bucket_unknown(F.col("health_cloud_ga_gender"), known=P.GENDERS, unknown=P.UNKNOWN).alias("gender"),
    )


@query(
    "bucket_collapse",
    with_ctes("accounts")
    + f""" SELECT id, CASE WHEN race IN ('Black or African American', 'Black or African American;Nonwhite')
         THEN 'Black or African American' WHEN race = 'White' THEN 'White or Caucasian'
         WHEN race IS NOT NULL AND race <> 'Prefer not to say' THEN 'Other or Mixed Race'
         ELSE '{P.UNKNOWN}' END AS race_group FROM accounts""",
)
def _(s, d):
    group = fn.bucket_collapse(F.col("race"), P.RACE_MAP, "Other or Mixed Race", P.UNKNOWN, ["Prefer not to say"])
    return view(s, d, "accounts").select("id", group.alias("race_group"))


@query(
    "numeric_bands",
    with_ctes("accounts")
    + f""" SELECT id, CASE WHEN age BETWEEN 18 AND 34 THEN '18 to 34 Years' WHEN age BETWEEN 35 AND 54
         THEN '35 to 54 Years' WHEN age BETWEEN 55 AND 74 THEN '55 to 74 Years' WHEN age >= 75 THEN '75+ Years'
         ELSE '{P.UNKNOWN}' END AS age_group
         FROM (SELECT id, TRY_CAST(trim(substr(health_cloud_ga_age, 1, 2)) AS DOUBLE) AS age FROM accounts)""",
)
def _(s, d):
    return view(s, d, "accounts").select(
        "id", fn.numeric_bands(F.col("health_cloud_ga_age"), P.AGE_BANDS, P.UNKNOWN).alias("age_group")
    )


@query(
    "day_bins",
    """SELECT o_orderkey, days, CASE WHEN days = 0 THEN '0. Baseline' WHEN days <= 30 THEN '1-30 Days'
       WHEN days <= 60 THEN '31-60 Days' WHEN days <= 90 THEN '61-90 Days' WHEN days <= 120 THEN '91-120 Days'
       WHEN days <= 150 THEN '121-150 Days' WHEN days <= 180 THEN '151-180 Days' ELSE '181+ Days' END AS day_group
       FROM (SELECT o_orderkey, CAST(date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate)
             AS INT) AS days FROM orders)""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    days = op.running_days(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate", "days")
    return days.select("o_orderkey", "days", fn.day_bins(F.col("days")).alias("day_group"))


@query(
    "freetext_yes_no",
    with_ctes("cases")
    + """ SELECT id, CASE WHEN t IS NULL OR denies THEN 0 ELSE 1 END AS issue_yes,
       CASE WHEN denies THEN 1 ELSE 0 END AS issue_no, CASE WHEN t IS NULL THEN 1 ELSE 0 END AS issue_missing
       FROM (SELECT id, int_ckl_physical_heath_issues AS t,
             int_ckl_physical_heath_issues = '' OR upper(int_ckl_physical_heath_issues) LIKE '%NONE%'
             OR upper(int_ckl_physical_heath_issues) IN ('NO', 'NO MENTIONED') AS denies FROM cases)""",
)
def _(s, d):
    out = fn.freetext_yes_no(view(s, d, "cases"), "int_ckl_physical_heath_issues", "issue_")
    return out.select("id", "issue_yes", "issue_no", "issue_missing")


@query(
    "yes_no_missing",
    with_ctes("cases")
    + """ SELECT id, CASE WHEN now = 'Yes' THEN 1 ELSE 0 END AS now_yes,
       CASE WHEN now = 'No' OR ever = 'No' THEN 1 ELSE 0 END AS now_no,
       CASE WHEN now IS NULL AND ever IS NULL THEN 1 ELSE 0 END AS now_missing,
       CASE WHEN ever = 'Yes' THEN 1 ELSE 0 END AS ever_yes, CASE WHEN ever = 'No' THEN 1 ELSE 0 END AS ever_no,
       CASE WHEN ever IS NULL THEN 1 ELSE 0 END AS ever_missing
       FROM (SELECT id, thoughts_of_killing_yourself_right_now AS now, any_thoughts_of_killing_yourself AS ever
             FROM cases)""",
)
def _(s, d):
    ever, now = "any_thoughts_of_killing_yourself", "thoughts_of_killing_yourself_right_now"
    out = fn.yes_no_missing(view(s, d, "cases").select("id", ever, now), ever, "ever_")
    return fn.yes_no_missing(out, now, "now_", implied_no=ever).drop(ever, now)


@query(
    "multi_select_flags",
    with_ctes("cases")
    + " SELECT id, "
    + ", ".join(
        f"CASE WHEN coalesce(contains(what_can_help_you_with, '{t}'), false) THEN 1 ELSE 0 END AS help_{n}"
        for n, t in P.HELP_TOPICS.items()
    )
    + ", "
    + " + ".join(
        f"(CASE WHEN coalesce(contains(what_can_help_you_with, '{t}'), false) THEN 1 ELSE 0 END)"
        for t in P.HELP_TOPICS.values()
    )
    + " AS help_number, CASE WHEN what_can_help_you_with IS NULL THEN 1 ELSE 0 END AS help_missing FROM cases",
)
def _(s, d):
    c = view(s, d, "cases").select("id", "what_can_help_you_with")
    tokens = {t: f"help_{n}" for n, t in P.HELP_TOPICS.items()}
    return fn.multi_select_flags(c, "what_can_help_you_with", tokens, "help_number", "help_missing").drop(
        "what_can_help_you_with"
    )
