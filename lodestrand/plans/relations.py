"""Queries over the star schema, events and labels: graphs, lookups, windows, metrics, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.operators import graph as G
from lodestrand.operators import sequences as S
from lodestrand.operators.rules import first_wins
from lodestrand.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select l_suppkey, count(distinct l_partkey) as n_parts, min(l_partkey) as first_part from lineitem group by l_suppkey")
def i3_adjacency(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return edges.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_parts"), F.min("l_partkey").alias("first_part"))


@query("select l_partkey, l_suppkey, rn::int as rank from (select *, row_number() over (partition by l_partkey order by l_suppkey) as rn from (select distinct l_partkey, l_suppkey from lineitem)) where rn <= 6")
def c26_dependency_answer(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_suppkey"))).where("rank <= 6")


def _tree(spark, sf_dir):
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    edge = lambda df, a, ka, b, kb: df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"))
    return edge(nation, "r", "n_regionkey", "n", "n_nationkey").union(edge(customer, "n", "c_nationkey", "c", "c_custkey")).union(edge(orders, "c", "o_custkey", "o", "o_orderkey"))


@query(
    "with recursive e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders), "
    "b(node, depth) as (select 'r1', 0 union select dst, depth + 1 from b join e on node = src where depth < 3) select node, min(depth) as depth from b group by node"
)
def i4_bounded_bfs(spark, sf_dir):
    return G.bounded_bfs(_tree(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"), 3)


@query(
    "with recursive e as (select p_partkey as src, case when p_partkey <= 3 then p_partkey % 3 + 1 else p_partkey // 3 end as dst from part), r(start, node) as (select p_partkey, dst from part join e on src = p_partkey union select start, dst from r join e on node = src) "
    "select start, count(*) as n_reached, max((start = node)::int) as on_cycle from r group by start"
)
def i5_impact_closure(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    edges = part.select(F.col("p_partkey").alias("src"), F.expr("case when p_partkey <= 3 then p_partkey % 3 + 1 else p_partkey div 3 end").alias("dst"))  # a ring of three, on which all paths end
    start = part.select(F.col("p_partkey").alias("start"))
    reached = G.closure(edges, start)
    return reached.groupBy("start").agg(F.count(F.lit(1)).alias("n_reached"), F.max((F.col("start") == F.col("node")).cast("int")).alias("on_cycle"))


@query("select p_name, min(p_partkey) as only_key from part group by p_name having count(*) = 1")
def c6_unique_name_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("only_key")).where("n = 1").drop("n")


@query(
    "with b as (select p_brand, min(p_partkey) as k from part where p_size < 10 group by p_brand), t as (select p_type, min(p_partkey) as k from part where p_size < 25 group by p_type) "
    "select p.p_partkey, coalesce(b.k, t.k, p.p_partkey) as resolved, case when b.k is not null then 'brand' when t.k is not null then 'type' else 'self' end as rule from part p left join b on p.p_brand = b.p_brand and p.p_size > 40 left join t on p.p_type = t.p_type"
)
def c5_lookup_cascade(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brand = part.where("p_size < 10").groupBy("p_brand").agg(F.min("p_partkey").alias("kb")).withColumnRenamed("p_brand", "b")
    kind = part.where("p_size < 25").groupBy("p_type").agg(F.min("p_partkey").alias("kt"))
    joined = part.join(brand, (F.col("p_brand") == F.col("b")) & (F.col("p_size") > 40), "left").join(kind, "p_type", "left")
    rule = F.when(F.col("kb").isNotNull(), "brand").when(F.col("kt").isNotNull(), "type").otherwise("self")
    return joined.select("p_partkey", F.coalesce("kb", "kt", "p_partkey").alias("resolved"), rule.alias("rule"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def c11_coverage_semi(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("select c_mktsegment, count(*) as n_missing from customer where not exists (select 1 from orders where o_custkey = c_custkey) group by c_mktsegment")
def c12_missing_anti(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_missing"))


@query("select o_orderkey from orders o where o_orderstatus = 'O' and exists (select 1 from orders f where f.o_orderstatus = 'F' and f.o_totalprice > 300000 and abs(f.o_orderkey - o.o_orderkey) <= 5)")
def c13_band_semi_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    # bands of 6 keys: whatever is within 5 lies in the same band or the next one
    marks = orders.where("o_orderstatus = 'F' and o_totalprice > 300000").select(F.col("o_orderkey").alias("mark"), F.explode(F.expr("array(o_orderkey div 6 - 1, o_orderkey div 6, o_orderkey div 6 + 1)")).alias("band"))
    opened = orders.where("o_orderstatus = 'O'").select("o_orderkey", F.expr("o_orderkey div 6").alias("band"))
    return opened.join(marks, (opened.band == marks.band) & (F.abs(F.col("mark") - F.col("o_orderkey")) <= 5), "left_semi").select("o_orderkey")


@query(
    "with a as (select p_brand, list_distinct(list(p_size)) as s from part where p_partkey % 2 = 0 group by p_brand), b as (select p_brand, list_distinct(list(p_size)) as s from part where p_partkey % 2 = 1 group by p_brand) "
    "select a.p_brand, len(list_filter(a.s, lambda x: not list_contains(b.s, x)))::int as n_lost from a join b on a.p_brand = b.p_brand where len(list_filter(a.s, lambda x: not list_contains(b.s, x))) > 0"
)
def c19_signature_difference(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.collect_set("p_size").alias("old"))
    new = part.where("p_partkey % 2 = 1").groupBy("p_brand").agg(F.collect_set("p_size").alias("new"))
    return old.join(new, "p_brand").select("p_brand", F.size(F.array_except("old", "new")).alias("n_lost")).where("n_lost > 0")


@query(
    "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over w as user_turn, coalesce(sum((role <> 'user')::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as replies_before "
    "from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)"
)
def e4_carry_and_running(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", S.carried(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "turn").alias("user_turn"), S.running_count(F.col("role") != "user", ["conv_id"], "turn", before=True).alias("replies_before")
    )


@query(
    "with s as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by event_id) as session from events) select user_id, session, min(event_id) as first_error from s where event_type = 'error' and session > 0 group by user_id, session"
)
def e7_loop_state(spark, sf_dir):
    hits = S.first_after_opener(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "error")
    return hits.select("user_id", "session", F.col("event_id").alias("first_error"))


@query(
    "with f as (select user_id, event_id, event_type, min(case when event_type = 'purchase' then event_id end) over w as next_use, min(case when event_type = 'view' then event_id end) over w as next_guard from events window w as (partition by user_id order by event_id rows between 1 following and unbounded following)) "
    "select event_id, next_use from f where event_type = 'signup' and next_use is not null and (next_guard is null or next_use < next_guard)"
)
def e9_assign_use_guard(spark, sf_dir):
    later = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("event_id"))).over(later)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", at("purchase").alias("next_use"), at("view").alias("next_guard"))
    return rows.where("event_type = 'signup' and next_use is not null and (next_guard is null or next_use < next_guard)").select("event_id", "next_use")


@query(
    "with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as rn, count(*) over (partition by event_type) as n from events) "
    "select event_type, round(median(value), 6) as p50, round(max(value) filter (rn = round_even(0.95 * (n - 1), 0)::bigint + 1), 6) as p95 from r group by event_type"
)
def d11_latency_percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value", "event_id")
    p95 = S.rank_percentile(events, "event_type", "value", 0.95).withColumnRenamed("value", "p95")
    return events.groupBy("event_type").agg(F.median("value").alias("p50")).join(p95, "event_type").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "with g as (select source, list(doc_id order by doc_id) as gold from labels join documents using (doc_id) where quality = 1 group by source), t as (select source, list(doc_id order by n_chars desc, doc_id)[1:10] as got from documents group by source) "
    "select g.source, len(list_filter(gold, lambda x: list_contains(got, x)))::int as hits, round(len(list_filter(gold, lambda x: list_contains(got, x))) / len(gold), 6) as recall_10, round(len(list_filter(got, lambda x: list_contains(gold, x))) / len(got), 6) as precision_10 from g join t on g.source = t.source"
)
def d12_recall_at_k(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    gold = table(spark, sf_dir, "labels").where("quality = 1").join(docs, "doc_id").select("source", "doc_id")
    got = docs.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("rn <= 10").select("source", "doc_id")
    n_gold, n_got = gold.groupBy("source").agg(F.count(F.lit(1)).alias("n_gold")), got.groupBy("source").agg(F.count(F.lit(1)).alias("n_got"))
    hits = gold.join(got, ["source", "doc_id"]).groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("h"))
    joined = n_gold.join(n_got, "source").join(hits, "source", "left").withColumn("hits", F.coalesce("h", F.lit(0)))
    return joined.select("source", "hits", F.round(F.col("hits") / F.col("n_gold"), 6).alias("recall_10"), F.round(F.col("hits") / F.col("n_got"), 6).alias("precision_10"))


@query("select lang, count(*) as n_docs, count(quality) as n_labelled, round(avg(quality), 6) as success, round(avg(case when toxic = 1 then n_chars end), 6) as toxic_chars from documents left join labels using (doc_id) group by lang")
def d9_eval_by_category(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("success"), F.round(F.avg(F.when(F.col("toxic") == 1, F.col("n_chars"))), 6).alias("toxic_chars"))


@query("select event_type, (props::json->>'$.k')::int as k, count(*) as n from events group by all")
def h14_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, case when event_type = 'error' and value < 20 then 'crash' when event_type = 'error' then 'assertion' when value is null then 'missing_validation' else 'ok' end as failure from events")
def p5_failure_classes(spark, sf_dir):
    kind = F.when((F.col("event_type") == "error") & (F.col("value") < 20), "crash").when(F.col("event_type") == "error", "assertion").when(F.col("value").isNull(), "missing_validation").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("failure"))


CASES = (("rate", "p_retailprice", "ge_zero"), ("rate", "p_retailprice", "le_one"), ("numeric", "p_size", "normal"), ("numeric", "p_size", "negative"), ("string", "p_name", "empty"))


@query("select p_partkey, kind || ':' || label as case_name from part, (values " + ", ".join(f"('{k}', '{c}', '{x}')" for k, c, x in CASES) + ") as c(kind, col, label) where p_size <= 10")
def p2_case_matrix(spark, sf_dir):
    cases = F.array(*[F.lit(f"{k}:{x}") for k, _, x in CASES])
    return table(spark, sf_dir, "part").where("p_size <= 10").select("p_partkey", F.explode(cases).alias("case_name"))


@query("with e as (select doc_id, lead(doc_id) over (partition by source order by doc_id) as nxt from documents), s as (select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id) as rn from documents) select s.doc_id, nxt as expanded, round(0.55::double * n_chars, 4) as score from s join e using (doc_id) where rn <= 3 and nxt is not null")
def c18_graph_expansion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    edges = docs.select("doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("expanded"))
    top = docs.orderBy(F.desc("n_chars"), "doc_id").limit(3)
    return top.join(edges, "doc_id").where("expanded is not null").select("doc_id", "expanded", F.round(0.55 * F.col("n_chars"), 4).alias("score"))


@query("select date_trunc('hour', ts)::timestamp as hour, event_type, count(*) as n_events from events group by all")
def m1_trace_stream(spark, sf_dir):
    from lodestrand.streaming.trace import hourly_counts

    return hourly_counts(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n_lines from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def d2_pricing_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz '1998-09-02 00:00:00'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n_lines"))


@query("select s_suppkey, s_name, s_acctbal from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier) where rn = 1")
def e10_top_per_group(spark, sf_dir):
    return first_wins(table(spark, sf_dir, "supplier"), ["s_nationkey"], F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", "s_name", "s_acctbal")
