"""Plans on orders, events and dimensions: joins, set operations, state, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import health as H
from millrace.operators import state as S
from millrace.operators.dedupe import first_sighting
from millrace.functions import values as V
from millrace.plans.core import table

QUERIES: dict = {}
ORACLES: dict = {}
NOW = "2024-01-31 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp")


@query("select o_orderkey, c_name, c_mktsegment from orders left join customer on c_custkey = o_custkey where o_orderstatus = 'F'")
def orders_left_customer(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_join_unlabelled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("select doc_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def semi_join_labelled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("select r_name, s.c_mktsegment from region, (select distinct c_mktsegment from customer) s")
def cross_join_region_segments(spark, sf_dir):
    # both sides are dimensions: five regions by the distinct segments
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "customer").select("c_mktsegment").distinct())


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def nation_region_lookup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("select n_name, count(c_custkey) n from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9900 group by 1")
def seeded_zero_counts(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer").filter("c_acctbal > 9900"), table(spark, sf_dir, "nation")
    return H.seeded_counts(n.select("n_name", "n_nationkey"), c.withColumnRenamed("c_nationkey", "n_nationkey").join(n.select("n_nationkey", "n_name"), "n_nationkey"), "n_name")


@query("select 'customer' kind, c_name as name from customer union all select 'supplier', s_name from supplier")
def union_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name")))


@query("select c_nationkey nationkey from customer intersect select s_nationkey from supplier")
def source_intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("select n_nationkey nationkey from nation except select s_nationkey from supplier where s_acctbal > 5000")
def source_difference(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey")).subtract(table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey)")
def fk_violations(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left_anti").select("l_orderkey", "l_linenumber")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) r from events) where r = 1")
def first_sighting_users(spark, sf_dir):
    return first_sighting(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"""with a as (select event_id, (epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 3.6e9 age from events)
select event_id, case when age > 24 then 'stale' else 'fresh' end verdict from a""")
def freshness_events(spark, sf_dir):
    age = V.age_hours(_now(), F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.when(age > 24, "stale").otherwise("fresh").alias("verdict"))


@query(f"""with s as (select o_orderkey, o_orderdate, (epoch_us(timestamp '1998-09-01') - epoch_us(o_orderdate)) / 1e6 s from orders)
select o_orderkey, case when s < 0 and s > -7200 then 'just now' when s < 0 and s > -172800 then 'in ' || cast(floor(-s / 3600) as bigint) || 'h' when s < 0 then 'in ' || cast(floor(-s / 86400) as bigint) || 'd'
 when s < 90 then 'just now' when s < 3600 then cast(floor(s / 60) as bigint) || 'm ago' when s < 86400 then cast(floor(s / 3600) as bigint) || 'h ago' when s < 172800 then 'yesterday'
 when s < 5184000 then cast(floor(s / 86400) as bigint) || 'd ago' else strftime(o_orderdate, '%Y-%m-%d') end ago from s""")
def relative_time_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.relative_time(F.lit("1998-09-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp")).alias("ago"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def json_props_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("""with e as (select user_id, event_id, event_type, value, max(event_type = 'purchase') over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) done from events),
l as (select * from e where not coalesce(done, false) or event_type = 'purchase')
select e0.user_id as key, l1.status, l1.score, e0.created, l1.updated from (select user_id, min(event_id) created from events group by 1) e0
join (select user_id, arg_max(event_type, event_id) status, arg_max(value, event_id) filter (value is not null) score, max(event_id) updated from l group by 1) l1 on l1.user_id = e0.user_id""")
def status_fold_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("status"), F.col("value").alias("score"))
    return S.fold_status(e, terminal="purchase")


@query(f"""with u as (select user_id, arg_max(event_type, event_id) status, max(ts) updated from events group by 1)
select user_id, case when status = 'purchase' then false else status not in ('purchase', 'signup', 'error') or updated < timestamp '{NOW}' - interval 2 day end surface from u""")
def surface_gate_events(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max(F.col("ts").cast("timestamp")).alias("updated"))
    return u.select("user_id", S.should_surface(F.col("status"), F.col("updated"), _now(), 2, ("purchase", "signup", "error"), "purchase").alias("surface"))


@query("""with o as (select user_id, arg_max(event_type, event_id) t, min(event_id) f, max(event_id) l, arg_min(value, event_id) v from events where event_id % 2 = 0 group by 1),
n as (select user_id, arg_max(event_type, event_id) t, min(event_id) f, max(event_id) l, arg_min(value, event_id) v from events where event_id % 2 = 1 group by 1)
select coalesce(o.user_id, n.user_id) as key, coalesce(o.t, n.t) title, coalesce(n.t, o.t) url, coalesce(n.t, o.t) as location, cast(coalesce(n.v, o.v) as varchar) is not null country_known,
coalesce(o.v, n.v) posted_at, coalesce(o.f, n.f) first_seen, coalesce(n.l, o.l) last_seen, o.user_id is null is_new from o full join n on o.user_id = n.user_id""")
def tracker_upsert_events(spark, sf_dir):
    def half(rest):
        e = table(spark, sf_dir, "events").filter(F.col("event_id") % 2 == rest).groupBy(F.col("user_id").alias("key"))
        e = e.agg(F.max_by("event_type", "event_id").alias("t"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.min_by("value", "event_id").alias("v"))
        return e.select("key", F.col("t").alias("title"), F.col("t").alias("url"), F.col("t").alias("location"), F.col("v").alias("country"), F.col("v").alias("posted_at"), "first_seen", "last_seen")

    out = S.upsert_jobs(half(0), half(1))
    return out.withColumn("country_known", F.col("country").isNotNull()).drop("country")


@query("select event_type, count(*) n from events group by 1")
def counts_by_status_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select count(*) filter (event_type = 'purchase') purchases, count(*) filter (event_type = 'error') errors, count(*) total from events")
def status_count_if(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("total"))


@query("select event_id, ts from events order by event_id desc limit 20")
def runs_recent_topn(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("event_id")).limit(20)


@query("""with d as (select event_type, cast(ts as date) as day, count(*) n from events group by 1, 2)
select event_type, day, n, avg(n) over (partition by event_type order by day rows between 5 preceding and 1 preceding) baseline from d""")
def daily_type_baseline(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return H.trailing_baseline(d, "event_type", "day", "n")


@query("""with g as (select user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 3.6e9 gap from events)
select user_id, event_id, gap from g where gap > 36""")
def gap_detection_users(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("gap", V.age_hours(F.col("ts").cast("timestamp"), before.cast("timestamp"))).filter("gap > 36").select("user_id", "event_id", "gap")


@query("""with b as (select n_name, count(s_suppkey) n from nation left join supplier on s_nationkey = n_nationkey group by 1) select n_name from b where n = 0""")
def silent_sources(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left_anti").select("n_name")
