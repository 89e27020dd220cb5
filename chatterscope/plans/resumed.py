"""Queries over work that is interrupted and goes on: verified copies, backfills, vendor switches; a dump as a source; natural order."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.operators import backfill as BF
from chatterscope.operators import copies as C
from chatterscope.operators import prices as P
from chatterscope.operators import selection as S
from chatterscope.operators import vendors as V
from chatterscope.plans.catalog import query
from chatterscope.sources import bindings as B
from chatterscope.sources import dump_source, shared


class Interrupted(Exception):
    pass


def once(after: int):
    """A progress hook that interrupts the work at its ``after``-th step."""
    steps = []

    def hook(*_) -> None:
        steps.append(1)
        if len(steps) == after:
            raise Interrupted

    return hook


@query("s1_dump_source", "SELECT c_custkey AS id, c_name || ', it''s (new)' || chr(10) AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey > 40 AND (c_custkey % 3 = 0 OR c_mktsegment <> 'BUILDING')")
def dump_source_rows(spark, sf):
    """The customers as a dump of several files in a folder, of which two columns are filtered before a row is decoded and one is not read."""
    dump_source.register(spark)
    c = B.read(spark, sf, "customer")
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    row = F.concat_ws(",", F.col("c_custkey").cast("string"), quoted(F.concat("c_name", F.lit(", it\\'s (new)\\n"))), quoted(F.lit("not read \\\\")), F.when(F.col("c_custkey") % 3 == 0, "NULL").otherwise(quoted(F.col("c_mktsegment"))))
    table = F.when(F.col("c_custkey") % 7 == 0, "others").otherwise("customers")
    at = shared.place(spark, "dump")
    c.select(F.concat(F.lit("INSERT INTO `"), table, F.lit("` VALUES ("), row, F.lit(");"))).repartition(3, "c_custkey").write.text(at)
    options = {"path": at, "table": "customers", "columns": "id,name,note,segment", "split": 64 << 10}
    rows = spark.read.format("sqldump").schema("id long, name string, segment string").options(**options).load()
    return rows.where("id > 40").where("segment is null or segment <> 'BUILDING'")


@query("s15_verified_copy", "SELECT 'customer' AS name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, CAST(sum(length(c_name)) AS BIGINT) AS size FROM customer UNION ALL SELECT 'events', count(*), CAST(sum(event_id) AS BIGINT), CAST(sum(length(props)) AS BIGINT) FROM events UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT), CAST(sum(length(l_returnflag)) AS BIGINT) FROM lineitem")
def verified_copy(spark, sf):
    """Three tables copied with an interruption in the second one, resumed, verified and opened."""
    keys = {"customer": ("c_custkey",), "events": ("event_id",), "lineitem": ("l_orderkey", "l_linenumber")}
    sizes = {"customer": "c_name", "events": "props", "lineitem": "l_returnflag"}
    tables, target = [C.Table(n, B.read(spark, sf, n), k) for n, k in keys.items()], shared.place(spark, "copy")
    try:
        C.copied(spark, tables, target, slices=2, progress=once(3))
    except Interrupted:
        C.copied(spark, tables, target, slices=2, resume=True)
    each = [C.opened(spark, target, t).agg(F.lit(t.name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(t.key[0]).alias("keys"), F.sum(F.length(sizes[t.name])).alias("size")) for t in tables]
    return each[0].unionByName(each[1]).unionByName(each[2])


def tickers(rows, pool):
    """A post's own ticker, or the only one that the pool has for its product."""
    out = rows.join(pool.select("code", F.col("ticker").alias("_t")), "code", "left")
    return out.select("feed_id", "code", F.coalesce("source_ticker", "_t").alias("ticker"))


@query("v35_resumed_backfill", B.ctes("feeds") + ", pool AS (SELECT code, min(source_ticker) AS t FROM feeds WHERE code <> 'view' GROUP BY 1 HAVING count(DISTINCT source_ticker) = 1), r AS (SELECT f.code, coalesce(f.source_ticker, p.t) AS ticker FROM feeds f LEFT JOIN pool p USING (code)) SELECT code, count(*) AS n, count(ticker) AS resolved, count(*) - count(ticker) AS unresolved, (SELECT count(*) = count(ticker) FROM r) AS active FROM r GROUP BY code")
def resumed_backfill(spark, sf):
    """Tickers filled in four ranges with an interruption after the second; live only if every post has one."""
    f = B.feeds(spark, sf).select("feed_id", "code", "source_ticker")
    pool = f.where("code <> 'view'").groupBy("code").agg(F.min("source_ticker").alias("ticker"), F.count_distinct("source_ticker").alias("_n")).where("_n = 1").drop("_n")
    fill = BF.Backfill(spark, shared.place(spark, "backfill"), tickers, "own ticker, else the pool's", pool, "feed_id", "ticker")
    try:
        fill.run(f, 4, progress=once(2))
    except Interrupted:
        fill.run(f, 2, resume=True)
    try:
        fill.activate()
        live = True
    except BF.NotReady:
        live = False
    return fill.audit("code").withColumn("active", F.lit(live))


BAR = "SELECT '{v}' AS vendor, '{i}' AS iv, code, session_date, arg_max(price, seq * 10 + sub) AS close FROM bars WHERE {w} GROUP BY 3, 4"
DELIVERED = (("main", "1d", "sub % 2 = 1"), ("main", "30m", "sub % 2 = 0 AND code NOT IN ('3', '6', '9')"), ("spare", "1d", "sub % 3 = 0 AND code <> '9'"), ("spare", "30m", "sub % 3 = 1"))
REFUSED = (("main", "30m", V.NO_DATA, "code IN ('3', '6', '9')"), ("main", "1d", "timeout", "code = '1'"), ("spare", "1d", "timeout", "code = '9'"))
NOW = "CASE WHEN code < '5' THEN 'old' WHEN code = '5' THEN 'main' ELSE 'spare' END"
SWITCH = (
    B.ctes("bars") + ", b AS (" + " UNION ALL ".join(BAR.format(v=v, i=i, w=w) for v, i, w in DELIVERED) + ")"
    ", p AS (SELECT code, vendor, iv, 'ok' AS status, '' AS reason, count(*) AS n FROM b GROUP BY 1, 2, 3" + "".join(f" UNION ALL SELECT DISTINCT code, '{v}', '{i}', 'unavailable', '{r}', 0 FROM bars WHERE {w}" for v, i, r, w in REFUSED) + ")"
    f", e AS (SELECT code, vendor, iv, bool_and(status = 'ok') AS ok, bool_or(status = 'ok' AND n > 0) AS some_, bool_and(status <> 'ok' AND reason = '{V.NO_DATA}') AS none_, bool_or(status <> 'ok' AND reason <> '{V.NO_DATA}') AS failed FROM p GROUP BY 1, 2, 3)"
    ", c AS (SELECT code, vendor, bool_and(ok AND some_) AND count(*) = 2 AS complete, bool_or(iv = '30m' AND none_) AND NOT bool_or(failed) AS empty FROM e GROUP BY 1, 2)"
    f", now AS (SELECT DISTINCT code, {NOW} AS vendor FROM bars)"
    ", ch AS (SELECT m.code, CASE WHEN m.empty AND coalesce(s.complete, false) THEN 'spare' ELSE 'main' END AS vendor FROM (SELECT * FROM c WHERE vendor = 'main') m LEFT JOIN (SELECT * FROM c WHERE vendor = 'spare') s USING (code))"
    ", x AS (SELECT ch.code, ch.vendor, CASE WHEN now.vendor = ch.vendor THEN 'merge' WHEN c.complete THEN 'replace' ELSE 'keep' END AS action, now.vendor AS was FROM ch JOIN now USING (code) JOIN c ON c.code = ch.code AND c.vendor = ch.vendor)"
    ", a AS (SELECT code, '1d' AS iv, session_date, arg_max(price, seq * 10 + sub) AS close FROM bars WHERE seq % 2 = 0 GROUP BY 1, 3)"
    ", f AS (SELECT x.code, x.vendor, x.action, b.iv, b.close FROM x JOIN b ON b.code = x.code AND b.vendor = x.vendor WHERE action <> 'keep' UNION ALL SELECT x.code, x.was, x.action, a.iv, a.close FROM x JOIN a USING (code) WHERE action = 'keep' OR (action = 'merge' AND NOT EXISTS (SELECT 1 FROM b WHERE b.code = a.code AND b.vendor = x.vendor AND b.iv = a.iv AND b.session_date = a.session_date)))"
    " SELECT code, action, vendor, iv AS \"interval\", count(*) AS n, CAST(sum(CAST(round(close * 10000) AS BIGINT)) AS BIGINT) AS closes FROM f GROUP BY 1, 2, 3, 4"
)


@query("v31_s14_vendor_switch", SWITCH)
def vendor_switch(spark, sf):
    """The active series after a delivery: whole series replace another vendor's, the active vendor's bars are merged, the rest stays."""
    bars = B.bars(spark, sf)
    made = lambda v, i, w: P.day_bars(bars.where(w)).select("code", F.lit(i).alias("interval"), "session_date", "close", F.lit(v).alias("vendor"))
    delivered = [made(*d) for d in DELIVERED]
    new = delivered[0]
    for d in delivered[1:]:
        new = new.unionByName(d)
    plan = new.groupBy("code", "vendor", "interval").agg(F.lit("ok").alias("status"), F.lit("").alias("reason"), F.count(F.lit(1)).alias("n"))
    for v, i, r, w in REFUSED:
        plan = plan.unionByName(bars.where(w).select("code", F.lit(v).alias("vendor"), F.lit(i).alias("interval"), F.lit("unavailable").alias("status"), F.lit(r).alias("reason"), F.lit(0).cast("long").alias("n")).distinct())
    active, at = made("", "1d", "seq % 2 = 0").withColumn("vendor", F.expr(NOW)), shared.place(spark, "active-bars")
    V.founded(at, active)
    now = bars.select("code", F.expr(NOW).alias("vendor")).distinct()
    choice = shared.written(V.chosen(plan, now, ["main", "spare"], ["1d", "30m"], "30m"), "choice")
    V.switched(spark, at, choice, new, ["interval", "session_date"])
    out = V.stored(spark, at, active).join(choice.select("code", "action"), "code")
    return out.groupBy("code", "action", "vendor", "interval").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("close") * 10000).cast("long")).alias("closes"))


@query("w13_natural_order", "WITH t AS (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS head, c_custkey % 120 AS number FROM customer) SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN head = '' OR head IS NULL THEN 1 ELSE 0 END, CASE WHEN head <> '' THEN head END, CASE WHEN head <> '' THEN number END, c_custkey) AS INTEGER) AS up, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN head = '' OR head IS NULL THEN 1 ELSE 0 END, CASE WHEN head <> '' THEN head END DESC, CASE WHEN head <> '' THEN number END DESC, c_custkey) AS INTEGER) AS down FROM t")
def natural_order(spark, sf):
    """Names such as BUILDING 9 and building 10 in their order within each nation, both ways; unknown ones last."""
    head = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    name = F.when(F.col("c_custkey") % 11 == 0, "").when(F.col("c_custkey") % 9 != 0, F.concat_ws(" ", head, (F.col("c_custkey") % 120).cast("string")))
    t = B.read(spark, sf, "customer").select("c_custkey", "c_nationkey", name.alias("name"))
    place = lambda down: F.row_number().over(W.partitionBy("c_nationkey").orderBy(*S.natural_order("name", ["c_custkey"], descending=down)))
    return t.select("c_custkey", place(False).alias("up"), place(True).alias("down"))
