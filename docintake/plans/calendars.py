"""Rota queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docintake.operators import rota
from docintake.plans.registry import query
from docintake.sources.views import load

_ROSTER = "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS ordinal, n_name AS name, concat('ou_', CAST(n_nationkey AS VARCHAR)) AS user_id FROM nation"
_DATES = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders"
_DUTY = f"SELECT d.date, r.ordinal, r.name, r.user_id FROM ({_DATES}) d JOIN ({_ROSTER}) r ON r.ordinal = ((date_diff('day', DATE '1998-01-01', d.date) % 25) + 25) % 25"


def _roster(spark, d):
    members = load(spark, d, "nation").select(F.lit(0).alias("list_id"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"), F.concat(F.lit("ou_"), F.col("n_nationkey").cast("string")).alias("user_id"))
    return rota.replace_roster(members).drop("list_id")


def _dates(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()


def _duty(spark, d):
    return rota.rotation(_dates(spark, d), _roster(spark, d), F.lit("1998-01-01").cast("date"))


@query("duty_rotation", _DUTY)
def _(spark, d):
    return _duty(spark, d)


@query("duty_texts", f"""WITH a AS ({_DUTY}) SELECT a.date, concat('今天（', CAST(a.date AS VARCHAR), '）值班：', a.name, chr(10), '明天（', CAST(CAST(a.date + 1 AS DATE) AS VARCHAR), '）值班：', coalesce(b.name, '未配置')) AS text FROM a LEFT JOIN a b ON b.date = a.date + 1""")
def _(spark, d):
    return rota.reminder_texts(_duty(spark, d))


@query("duty_roster_parse", """SELECT list_id, CAST(ordinal AS INT) AS ordinal, name, user_id FROM (SELECT c_nationkey AS list_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ordinal, name, user_id FROM (
  SELECT c_nationkey, c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat('ou_', CAST(c_custkey % 40 AS VARCHAR)) ELSE c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE concat('ou_', CAST(c_custkey % 40 AS VARCHAR)) END AS user_id,
    row_number() OVER (PARTITION BY c_nationkey, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE concat('ou_', CAST(c_custkey % 40 AS VARCHAR)) END ORDER BY c_custkey) AS n FROM customer) x WHERE n = 1) y""")
def _(spark, d):
    ident = F.concat(F.lit("ou_"), (F.col("c_custkey") % 40).cast("string"))
    member = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, ident).otherwise(F.concat("c_name", F.lit(" = "), ident))
    lists = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("list_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", member.alias("m")))), lambda x: x["m"]), ", ").alias("text"))
    return rota.parse_roster(lists)


@query("duty_roster_list", """SELECT CAST(c_nationkey AS INT) AS list_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS ordinal, c_name AS name, concat('ou_', CAST(c_custkey AS VARCHAR)) AS user_id FROM customer WHERE c_custkey % 6 <> 0""")
def _(spark, d):
    members = load(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("list_id"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 6 == 0, " ").otherwise(F.concat(F.lit("ou_"), F.col("c_custkey").cast("string"))).alias("user_id"))
    return rota.replace_roster(members)


_LOG = "SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'reserve' WHEN 'P' THEN 'sent' ELSE 'failed' END AS event FROM orders"
_LEDGER = f"""SELECT date, CASE arg_max(event, seq) WHEN 'reserve' THEN 'sending' ELSE arg_max(event, seq) END AS status, count(*) FILTER (event = 'reserve') AS attempts
FROM (SELECT *, min(seq) FILTER (event = 'sent') OVER (PARTITION BY date) AS s FROM ({_LOG}) l) x WHERE s IS NULL OR seq <= s GROUP BY date"""


def _ledger(spark, d):
    o = load(spark, d, "orders")
    return rota.reminder_ledger(o.select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "reserve").when(F.col("o_orderstatus") == "P", "sent").otherwise("failed").alias("event")))


@query("duty_ledger", _LEDGER)
def _(spark, d):
    return _ledger(spark, d)


@query("duty_due", f"SELECT date FROM ({_LEDGER}) x WHERE status <> 'sent'")
def _(spark, d):
    return rota.due_dates(_dates(spark, d), _ledger(spark, d))


@query("duty_history", f"SELECT date, status, attempts FROM ({_LEDGER}) x ORDER BY date DESC LIMIT 30")
def _(spark, d):
    return _ledger(spark, d).orderBy(F.desc("date")).limit(30)


@query("duty_calendar", "SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date FROM orders")
def _(spark, d):
    span = load(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return rota.calendar(F.col("a"), F.col("b"), span)
