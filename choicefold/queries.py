"""Queries of the engine's operators over the star-schema tables, and the same in SQL.

A customer is an observation with five synthetic items (see :func:`choicefold.sources.tables.items`); line items
stand for a log of cuts (agent = order, key = part, violation = discounted price) and of duals; events are ordered readings.
Floats are rounded where sums of them are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import draws
from .functions.layout import Parameters
from .functions.vectors import item, literal
from .operators import agents as ax
from .operators import cuts as cx
from .operators import duals as dx
from .operators import moments, pricing, reduce, replications, schedules
from .plans import fit
from .sources.tables import items, numbered, table

THETA = (0.1875, -0.0625, 0.25, -0.125, 0.03125)
SIMS = 3
SHARDS = 7
BOX = Parameters({"taste": (-10.0, 10.0, 5)})
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The items of customers in SQL: a row per customer and item.
ITEMS = """cells as (select c_custkey a, k, case when (c_custkey*31+k*17)%2=0 then 1.0::double else -1.0::double end r,
  ((c_custkey*37+k*53)%101-50)/128.0::double + 1/1024.0::double nu,
  ((c_custkey*59+k*29)%103-51)/128.0::double + 1/1024.0::double nu0,
  [0.25,-0.125,0.1875,-0.25,0.0625][k]::double tt, [0.1875,-0.0625,0.25,-0.125,0.03125][k]::double th
  from customer, (select unnest([1,2,3,4,5]) k)),
items as (select *, case when r*tt+nu0>0 then 1 else 0 end b, case when r*th+nu>0 then 1 else 0 end d from cells)"""


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _obs(spark: SparkSession, d: str) -> DataFrame:
    """Observations; customer keys are dense from 0, so they are the ids."""
    return items(table(spark, d, "customer")).withColumnRenamed("key", "obs_id")


def _n(spark: SparkSession, d: str) -> int:
    return table(spark, d, "customer").count()


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.Modular(5).priced(_obs(spark, d).withColumn("agent_id", F.col("obs_id")), literal(THETA))


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    """Line items as candidate cuts."""
    v = F.col("l_extendedprice") * (1 - F.col("l_discount")) - 20000
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("agent_id"), F.col("l_partkey").alias("bundle_key"), F.expr("(l_orderkey*8+l_linenumber)*1000000000+l_partkey*10000+l_suppkey").alias("pos"), v.alias("violation"), F.col("l_quantity").alias("epsilon"), F.col("l_suppkey").alias("supp"))


CUTS = """cuts as (select l_orderkey agent_id, l_partkey bundle_key, (l_orderkey*8+l_linenumber)*1000000000+l_partkey*10000+l_suppkey pos, l_extendedprice*(1-l_discount)-20000 violation, l_quantity epsilon, l_suppkey supp from lineitem)"""


# -- sources and shards ---------------------------------------------------------------------------------------------------


@query(f"select (s*(select count(*) from customer)+c_custkey)::bigint agent_id, c_custkey obs_id, s::int sim_id from customer, (select unnest(range({SIMS})) s)")
def agent_expansion(spark, d):
    return ax.expand(_obs(spark, d), _n(spark, d), SIMS).select("agent_id", "obs_id", "sim_id")


@query(f"""with n as (select count(*) n from customer) select c_custkey agent_id, (case when c_custkey < (n%{SHARDS})*(n//{SHARDS}+1) then c_custkey//(n//{SHARDS}+1)
  else (n%{SHARDS}) + (c_custkey-(n%{SHARDS})*(n//{SHARDS}+1))//(n//{SHARDS}) end)::int shard from customer, n""")
def owner_of_agent(spark, d):
    return _obs(spark, d).select(F.col("obs_id").alias("agent_id"), ax.owner(F.col("obs_id"), _n(spark, d), SHARDS).alias("shard"))


@query(f"select ntile-1 shard, min(c_custkey) first, max(c_custkey) last, count(*)::bigint n from (select c_custkey, ntile({SHARDS}) over (order by c_custkey) ntile from customer) group by 1")
def contiguous_shards(spark, d):
    o = _obs(spark, d).select("obs_id")
    s = ax.owner(F.col("obs_id"), _n(spark, d), SHARDS).cast("long").alias("shard")
    return o.groupBy(s).agg(F.min("obs_id").alias("first"), F.max("obs_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"select c_custkey agent_id, (c_custkey%{SHARDS})::int shard from customer")
def cyclic_shards(spark, d):
    return _obs(spark, d).select(F.col("obs_id").alias("agent_id"), ax.owner(F.col("obs_id"), _n(spark, d), SHARDS, ax.CYCLIC).alias("shard"))


@query("select c_custkey agent_id, coalesce(sum(o_totalprice)/count(o_totalprice), 0.0) value from customer left join (select * from orders where o_orderpriority like '1%') on c_custkey=o_custkey group by 1".replace("sum(o_totalprice)/count(o_totalprice)", "max(o_totalprice)"))
def gather_agent_values(spark, d):
    v = table(spark, d, "orders").where("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("agent_id")).agg(F.max("o_totalprice").alias("value"))
    return ax.dense(v, _n(spark, d))


@query("select c_custkey agent_id, c_acctbal value from customer where c_custkey in (select o_custkey from orders where o_orderpriority like '5%')")
def scatter_by_agent(spark, d):
    ids = table(spark, d, "orders").where("o_orderpriority like '5%'").select(F.col("o_custkey").alias("agent_id")).distinct()
    return ax.scattered(table(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"), F.col("c_acctbal").alias("value")), ids)


@query("select n_nationkey::bigint rep_id, ((n_nationkey % 5))::int rank from nation".replace("n_nationkey % 5", "[0,2,4,1,3][(n_nationkey % 5)+1]"))
def replication_owners(spark, d):
    ranks = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 2, 0)], "rank int, node_id int, node_rank int")
    return ax.interleaved_owners(ranks, 25).select(F.col("rep_id").cast("long").alias("rep_id"), "rank")


@query("select row_number() over (order by o_orderkey)-1 obs_id, o_orderkey from orders")
def dense_numbering(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return numbered(o, o["o_orderkey"]).select("obs_id", "o_orderkey")


# -- features, moments, objective -------------------------------------------------------------------------------------------


@query(f"with {ITEMS} select (k-1)::int pos, sum(r*b)/count(*) moment from items group by k")
def observed_moment(spark, d):
    o = _obs(spark, d)
    phi = o.select(pricing.Modular(5).observed(o).alias("phi"))
    return moments.empirical_moment(phi, 5).select(F.posexplode("moment").alias("pos", "moment"))


@query(f"with {ITEMS} select (k-1)::int pos, -{SIMS}.0*sum(r*b) c from items group by k")
def objective_coefficients(spark, d):
    o = _obs(spark, d)
    phi = o.select(pricing.Modular(5).observed(o).alias("phi"))
    return moments.objective_coefficients(phi, 5, SIMS).select(F.posexplode("c").alias("pos", "c"))


@query(f"with {ITEMS}, w as (select o_custkey a, count(*)::double w from orders group by 1) select (k-1)::int pos, -sum(w*r*b) c from items join w using (a) group by k")
def weighted_objective(spark, d):
    o = _obs(spark, d)
    w = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("obs_id")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    phi = o.select("obs_id", pricing.Modular(5).observed(o).alias("phi")).join(w, "obs_id")
    return moments.objective_coefficients(phi, 5, 1, "w").select(F.posexplode("c").alias("pos", "c"))


@query("select o_orderkey, [o_totalprice, 1.0, 2.0][1:1] price, [o_totalprice, 1.0, 2.0][2:3] rest from orders")
def parameter_blocks(spark, d):
    p = Parameters({"price": (0.0, 1.0, 1), "rest": (-1.0, 1.0, 2)})
    named = table(spark, d, "orders").select("o_orderkey", p.named(F.array("o_totalprice", F.lit(1.0), F.lit(2.0))).alias("m"))
    return named.select("o_orderkey", F.col("m")["price"].alias("price"), F.col("m")["rest"].alias("rest"))


# -- pricing ---------------------------------------------------------------------------------------------------------------


@query(f"with {ITEMS} select a agent_id, sum(greatest(r*th+nu, 0)) payoff, string_agg(d::varchar, '' order by k) bundle, sum(d*nu) epsilon from items group by a")
def price_modular(spark, d):
    return pricing.with_key(_priced(spark, d)).select("agent_id", "payoff", F.decode("bundle_key", "UTF-8").alias("bundle"), "epsilon")


_SETS = "sets as (select m, [(m//4)%2, (m//2)%2, m%2] b from (select unnest(range(8)) m))"
_SCORES = f"""with {ITEMS}, wide as (select a, list(r order by k) r, list(nu order by k) nu from items group by a), {_SETS},
scores as (select a, m, b, r, nu, 0.5::double*(r[1]*b[1]+r[2]*b[2]+r[3]*b[3]) + 0.125::double*b[1] - 0.25::double*b[2] + 0.0625::double*b[3] + nu[1]*b[1]+nu[2]*b[2]+nu[3]*b[3] s from wide, sets)"""


def _three(spark, d):
    return _obs(spark, d).select(F.col("obs_id").alias("agent_id"), F.slice("r", 1, 3).alias("x"), F.slice("nu", 1, 3).alias("nu"), (F.lit(1.0) + (F.col("obs_id") % 3)).alias("capacity"))


@query(_SCORES + " select a agent_id, s payoff, b[1]*4+b[2]*2+b[3] bundle from (select *, row_number() over (partition by a order by s desc, m) n from scores) where n=1")
def price_enumerated(spark, d):
    p = pricing.Enumerated(3).priced(_three(spark, d), literal((0.5, 0.125, -0.25, 0.0625)))
    return p.select("agent_id", "payoff", (item("bundle", 0) * 4 + item("bundle", 1) * 2 + item("bundle", 2)).cast("long").alias("bundle"))


@query(f"""with {ITEMS}, wide as (select a, list(r order by k) r, list(nu order by k) nu from items group by a), {_SETS},
scores as (select a, m, b, 0.5::double*(r[1]*b[1]+r[2]*b[2]+r[3]*b[3]) - 0.125::double*b[1] + 0.25::double*b[2] - 0.0625::double*b[3] + 0.5::double*(0.5*b[1]*b[2]+0.25*b[2]*b[3]) + nu[1]*b[1]+nu[2]*b[2]+nu[3]*b[3] s
 from wide, sets where 1.0*b[1]+1.5*b[2]+0.5*b[3] <= 1.0+(a%3))
select a agent_id, s payoff, b[1]*4+b[2]*2+b[3] bundle from (select *, row_number() over (partition by a order by s desc, m) n from scores) where n=1""")
def price_capacity(spark, d):
    o = pricing.Enumerated(3, (1.0, 1.5, 0.5), ((0, 1, 0.5), (1, 2, 0.25)))
    p = o.priced(_three(spark, d), literal((0.5, 0.125, -0.25, 0.0625, 0.5)))
    return p.select("agent_id", "payoff", (item("bundle", 0) * 4 + item("bundle", 1) * 2 + item("bundle", 2)).cast("long").alias("bundle"))


@query(f"""with {ITEMS}, inside as (select a, k, 0.25::double*r + nu s from items where k<=4), best as (select * from (select *, row_number() over (partition by a order by s desc, k) n from inside) where n=1)
select a agent_id, (case when s > nu then k-1 else 4 end)::int choice, greatest(s, nu) payoff from best join (select a, nu from items where k=5) using (a)""")
def price_unit_demand(spark, d):
    o = _obs(spark, d).select(F.col("obs_id").alias("agent_id"), F.transform(F.slice("r", 1, 4), lambda x: F.array(x)).alias("x"), "nu")
    p = pricing.UnitDemand(1, 4).priced(o, literal((0.25,)))
    return p.select("agent_id", (F.array_position("bundle", F.lit(1.0)) - 1).cast("int").alias("choice"), "payoff")


_U = "u as (select o_custkey a, max(o_totalprice)/1000000 u from orders where o_orderpriority like '1%' group by 1), pay as (select a, sum(greatest(r*th+nu,0)) payoff from items group by a)"


def _rc(spark, d):
    u = table(spark, d, "orders").where("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("agent_id")).agg((F.max("o_totalprice") / 1000000).alias("u"))
    return pricing.reduced_cost(_priced(spark, d), u)


@query(f"with {ITEMS}, {_U} select a agent_id, round(payoff-coalesce(u,0.0),12) rc from pay left join u using (a)")
def reduced_costs(spark, d):
    return _rc(spark, d).select("agent_id", F.round("rc", 12).alias("rc"))


@query(f"with {ITEMS}, {_U} select a agent_id from pay left join u using (a) where payoff-coalesce(u,0.0) > 0.45")
def violated_agents(spark, d):
    return _rc(spark, d).where(F.col("rc") > 0.45).select("agent_id")


@query(f"with {ITEMS}, {_U} select round(greatest(max(payoff-coalesce(u,0.0)),0),12) worst from pay left join u using (a)")
def worst_reduced_cost(spark, d):
    return _rc(spark, d).agg(F.round(reduce.greatest_violation(F.col("rc")), 12).alias("worst"))


@query(f"with {ITEMS} select a%5 rep_id, round(max(p),9) worst from (select a, sum(greatest(r*th+nu,0)) p from items group by a) group by 1")
def batched_worst(spark, d):
    return reduce.batched_max(_priced(spark, d).withColumn("rep_id", F.col("agent_id") % 5), "payoff").select("rep_id", F.round("worst", 9).alias("worst"))


@query(f"with {ITEMS} select (k-1)::int pos, sum(d*r)::double phi, (select sum(d*nu) from items) epsilon, (select count(*) from customer)::bigint n_priced from items group by k")
def aggregate_cut(spark, d):
    return moments.aggregate_cut(_priced(spark, d), 5).select(F.posexplode("phi").alias("pos", "phi"), "epsilon", "n_priced")


@query(f"with {ITEMS} select a agent_id, round(sum(d*r*tt)+sum(d*nu)-0.125,9) violation from items group by a")
def candidate_violations(spark, d):
    v = pricing.violation(_priced(spark, d), literal((0.25, -0.125, 0.1875, -0.25, 0.0625)), F.lit(0.125), 5)
    return _priced(spark, d).select("agent_id", F.round(v, 9).alias("violation"))


# -- cuts ---------------------------------------------------------------------------------------------------------------------


@query(f"with {CUTS} select agent_id, bundle_key, pos from (select *, row_number() over (partition by agent_id%1000, bundle_key order by pos) n from cuts) where n=1")
def dedup_cuts(spark, d):
    c = _cuts(spark, d).withColumn("a", F.col("agent_id") % 1000).select("a", "bundle_key", "pos", "agent_id")
    return cx.deduplicated(c, ("a", "bundle_key")).select("agent_id", "bundle_key", "pos")


@query(f"with {CUTS} select agent_id, bundle_key, min(pos) pos from cuts group by 1, 2")
def dedup_cuts_whole(spark, d):
    """One cut for each agent and key; ``dedup_cuts`` folds agents by 1000, as its SQL does."""
    return cx.deduplicated(_cuts(spark, d).select("agent_id", "bundle_key", "pos"))


@query(f"with {CUTS} select row_number() over (order by supp%3, agent_id, bundle_key, pos) n, pos from cuts where agent_id<500")
def canonical_cut_order(spark, d):
    from pyspark.sql import Window as W

    c = cx.canonical_order(_cuts(spark, d).where("agent_id<500").withColumn("rep_id", F.col("supp") % 3))
    return c.select(F.row_number().over(W.orderBy("rep_id", "agent_id", "bundle_key", "pos")).cast("long").alias("n"), "pos")


@query(f"with {CUTS} select row_number() over (order by supp%3, agent_id, bundle_key, pos) n, pos from cuts")
def canonical_cut_order_whole(spark, d):
    """The order of the whole log; ``canonical_cut_order`` orders the cuts of agents below 500, as its SQL does."""
    return cx.canonical_positions(_cuts(spark, d).withColumn("rep_id", F.col("supp") % 3)).select("n", "pos")


@query(f"with {CUTS} select agent_id, bundle_key, pos from cuts where (agent_id, bundle_key) not in (select agent_id, bundle_key from cuts where epsilon > 25)")
def fresh_cuts(spark, d):
    c = _cuts(spark, d)
    return cx.fresh(c, c.where("epsilon > 25")).select("agent_id", "bundle_key", "pos")


@query(f"with {CUTS}, new as (select agent_id, bundle_key, max(epsilon)+100 e from cuts where supp%2=0 group by 1,2) select c.agent_id, c.bundle_key, c.pos, coalesce(e, epsilon) epsilon from cuts c left join new n on c.agent_id=n.agent_id and c.bundle_key=n.bundle_key")
def rewrite_rhs(spark, d):
    c = _cuts(spark, d)
    new = c.where("supp%2=0").groupBy("agent_id", "bundle_key").agg((F.max("epsilon") + 100).alias("epsilon"))
    return cx.rewritten(c, new).select("agent_id", "bundle_key", "pos", "epsilon")


@query(f"with {CUTS} select pos, round(violation,6) violation from cuts where violation>0 order by cuts.violation desc, pos limit 100")
def admit_most_violated_k(spark, d):
    return cx.MostViolated(k=100).admit(_cuts(spark, d)).select("pos", F.round("violation", 6).alias("violation"))


@query(f"with {CUTS}, v as (select *, row_number() over (order by violation desc, pos) n, count(*) over () m from cuts where violation>0) select pos from v where n <= greatest(1, floor(0.05*m))")
def admit_fraction(spark, d):
    return cx.MostViolated(fraction=0.05).admit(_cuts(spark, d)).select("pos")


@query(f"with {CUTS} select pos from cuts where violation > 5000")
def admit_threshold(spark, d):
    return cx.ViolationThreshold(5000.0).admit(_cuts(spark, d)).select("pos")


@query(f"with {CUTS} select pos from (select * from cuts where violation>5000 and violation>0) v order by v.violation desc, pos limit 50")
def compose_policies(spark, d):
    return cx.Compose((cx.ViolationThreshold(5000.0), cx.MostViolated(k=50))).admit(_cuts(spark, d)).select("pos")


def _readings(spark, d):
    return _cuts(spark, d).select("agent_id", F.col("pos").alias("bundle_key"), "pos", F.when(F.col("supp") % 10 != 0, F.col("epsilon")).alias("slack"), F.lit(None).cast("double").alias("dual"))


@query(f"with {CUTS}, r as (select pos, epsilon slack from cuts where supp%10<>0) select pos from r where slack > (select quantile_cont(slack, 0.9) from r)")
def retire_loose_percentile(spark, d):
    return cx.SlackStrip(90.0).retire(_readings(spark, d)).select(F.col("bundle_key").alias("pos"))


@query(f"""with {CUTS}, r as (select pos, epsilon slack from cuts where supp%10<>0), k as (select *, row_number() over (order by slack, pos) n from r where slack <= (select quantile_cont(slack, 0.9) from r))
select pos from r where pos not in (select pos from k where n<=1000)""")
def retire_cap(spark, d):
    return cx.SlackStrip(90.0, 1000).retire(_readings(spark, d)).select(F.col("bundle_key").alias("pos"))


_EVENTS = "ev as (select user_id, event_id, case when event_type='click' then 0.0 else value end v from events)"


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", 0.0).otherwise(F.col("value")).alias("v"))


@query(f"with {_EVENTS}, l as (select user_id, max(case when abs(v)>1e-10 then event_id end) last from ev where v is not null group by 1) select user_id, count(case when abs(v)<=1e-10 and (last is null or event_id>last) then 1 end)::bigint streak from ev join l using (user_id) where v is not null group by 1")
def retire_inactive_streak(spark, d):
    return cx.streaks(_events(spark, d), ("user_id",), "v", "event_id")


@query(f"with {CUTS}, a as (select agent_id, bundle_key from cuts where violation>30000), b as (select agent_id, bundle_key from cuts where epsilon>45) select agent_id, bundle_key from a union select agent_id, bundle_key from b")
def union_of_votes(spark, d):
    class Above(cx.CutPolicy):
        def __init__(self, column, least):
            self.column, self.least = column, least

        def retire(self, readings):
            return readings.where(F.col(self.column) > self.least).select(*cx.KEY)

    return cx.Compose((), (Above("violation", 30000), Above("epsilon", 45))).retire(_cuts(spark, d))


@query(f"with {CUTS} select agent_id, bundle_key, pos from cuts where (agent_id, bundle_key) not in (select agent_id, bundle_key from cuts where violation < 0)")
def remove_cuts(spark, d):
    c = _cuts(spark, d)
    return cx.removed(c, c.where("violation < 0")).select("agent_id", "bundle_key", "pos")


@query(f"with {CUTS} select supp%4 rep_id, count(*)::bigint n, min(pos) first from cuts group by 1")
def exchange_cuts(spark, d):
    """Every replication's cuts land together: one partition holds all of it."""
    c = cx.exchanged(_cuts(spark, d).withColumn("rep_id", F.col("supp") % 4), 4).withColumn("p", F.spark_partition_id())
    g = c.groupBy("rep_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.count_distinct("p").alias("parts"))
    return g.where("parts = 1").select("rep_id", "n", "first")


@query("select unnest([0,1])::int pos, unnest([sum(l_linenumber), sum(floor(l_quantity))])::double total from lineitem")
def vector_sum(spark, d):
    parts = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("rank")).agg(F.array(F.sum("l_linenumber").cast("double"), F.sum(F.floor("l_quantity")).cast("double")).alias("v"))
    return reduce.canonical_vector_sum(parts, "v", "rank", 2).select(F.posexplode("total").alias("pos", "total"))


@query("select c_custkey agent_id from customer where c_custkey % 7 = 0 or c_custkey % 10 = 3")
def feature_disagreement(spark, d):
    p = _priced(spark, d)
    other = p.where("agent_id % 10 <> 3").withColumn("epsilon", F.col("epsilon") + F.when(F.col("agent_id") % 7 == 0, 1e-6).otherwise(1e-15))
    return pricing.disagreement(p, other, 5)


@query("select c_custkey agent_id from customer where c_custkey % 9 = 0")
def missing_answers(spark, d):
    p = _priced(spark, d)
    return pricing.missing_answers(p, p.where("agent_id % 9 <> 0"))


@query("select c_custkey iteration, case when c_custkey < 20 then 1.0 when c_custkey < 50 then 5.0 else 60.0 end time_limit, case when c_custkey = 0 then 1 else 0 end focus, case when c_custkey < 20 then 20 when c_custkey < 50 then 0 else -1 end floor from customer")
def phase_lookup(spark, d):
    from .plans.callbacks import Phase, TimeoutSchedule

    s = TimeoutSchedule([Phase(1.0, 20), Phase(5.0, 30, retire=True), Phase(60.0)])
    rows = [(i, v.time_limit_seconds, v.mip_focus, -1 if f is None else f) for i in range(_n(spark, d)) for v, f in [s.at(i, None)]]
    return spark.createDataFrame(rows, "iteration bigint, time_limit double, focus int, floor int")


# -- duals, schedules ------------------------------------------------------------------------------------------------------


def _duals(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 3).cast("int").alias("rep_id"), F.col("l_orderkey").alias("agent_id"), F.array((F.col("l_linenumber") % 2).cast("double"), (F.col("l_partkey") % 3).cast("double"), F.lit(1.0)).alias("bundle"), (F.floor(F.col("l_quantity")) / 64).alias("pi"), F.expr("(l_orderkey*8+l_linenumber)*1000000000+l_partkey*10000+l_suppkey").alias("pos"))


_DUALS = "du as (select (l_suppkey%3)::int rep_id, l_orderkey agent_id, (l_linenumber%2)::double b0, (l_partkey%3)::double b1, floor(l_quantity)/64 pi, (l_orderkey*8+l_linenumber)*1000000000+l_partkey*10000+l_suppkey pos from lineitem)"


@query(f"with {_DUALS} select agent_id, round(max(pi)/sum(pi),9) share from du where pi>1e-10 group by 1")
def dual_concentration(spark, d):
    return schedules.concentration(_duals(spark, d)).select("agent_id", F.round("share", 9).alias("share"))


@query(f"with {_DUALS}, c as (select agent_id, max(pi)/sum(pi) share from du where pi>1e-10 group by 1) select o_orderkey agent_id from orders left join c on agent_id=o_orderkey where not (share is not null and share>=0.6 and 10-(o_orderkey%10) < 5)")
def dual_informed_mask(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("agent_id"))
    last = o.withColumn("iteration", (F.col("agent_id") % 10).cast("int"))
    return schedules.DualInformed(0.6, 5).select(o, 0, 10, _duals(spark, d), last)


@query(f"select c_custkey agent_id from (select c_custkey, ntile({SHARDS}) over (order by c_custkey) t from customer) where t=3")
def round_robin_mask(spark, d):
    return schedules.RoundRobin(SHARDS).select(_obs(spark, d).select(F.col("obs_id").alias("agent_id")), _n(spark, d), 2 + SHARDS)


@query("select user_id agent_id, (1000-max(event_id%1000))::bigint age from events group by 1")
def staleness(spark, d):
    return schedules.staleness(table(spark, d, "events").select(F.col("user_id").alias("agent_id"), (F.col("event_id") % 1000).alias("iteration")), 1000)


@query(f"with {_DUALS} select rep_id, unnest([0,1,2])::int pos, unnest([sum(pi*b0), sum(pi*b1), sum(pi)]) m from du group by rep_id")
def dual_moment(spark, d):
    coded, bundles = dx.dictionary(_duals(spark, d))
    return dx.moment(coded, bundles, 3).select("rep_id", F.posexplode("moment").alias("pos", "m"))


@query(f"with {_DUALS}, f as (select rep_id, b0, b1, min(pos) p from du group by all) select rep_id, (row_number() over (partition by rep_id order by p)-1)::bigint bundle_row_id, b0, b1 from f")
def bundle_dictionary(spark, d):
    _, t = dx.dictionary(_duals(spark, d))
    return t.select("rep_id", F.col("bundle_row_id").cast("long").alias("bundle_row_id"), item("bundle", 0).alias("b0"), item("bundle", 1).alias("b1"))


@query(f"with {_DUALS}, n as (select count(*) n from customer) select rep_id, agent_id%n obs_id, (agent_id//n)::int sim_id, b0, b1, pi from du, n")
def decode_duals(spark, d):
    coded, t = dx.dictionary(_duals(spark, d))
    return dx.rows(coded, t, _n(spark, d)).select("rep_id", "obs_id", "sim_id", item("bundle", 0).alias("b0"), item("bundle", 1).alias("b1"), "pi")


@query("select sum(floor(l_quantity)) total, avg(floor(l_quantity)) mean, max(floor(l_quantity)) max, count(*) filter (floor(l_quantity)=0)::bigint n_zero from lineitem")
def slack_summary(spark, d):
    return dx.slack_summary(table(spark, d, "lineitem").select(F.floor("l_quantity").cast("double").alias("slack")))


@query("select count(*)::bigint n_priced, count(*) filter (l_discount>0)::bigint n_inexact, max(l_discount) worst_gap from lineitem")
def certification_report(spark, d):
    return dx.certification(table(spark, d, "lineitem").select(F.col("l_discount").alias("gap")))


@query("select event_id, user_id, round(value - lag(value) over (partition by user_id order by event_id),9) gap_delta from events")
def convergence_trace(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", F.col("event_id").alias("iteration"), F.col("value").alias("gap"))
    return dx.convergence_trace(t, "user_id").select("event_id", "user_id", F.round("gap_delta", 9).alias("gap_delta"))


@query("select (sum(floor(o_totalprice)))::double/128 total from orders")
def canonical_sum(spark, d):
    return reduce.canonical_sum(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") / 128).alias("v")), "v", "id")


@query("""select round(covar_samp(p_retailprice, l_extendedprice)/var_samp(p_retailprice),6) ols, round(covar_samp(l_quantity, l_extendedprice)/covar_samp(l_quantity, p_retailprice*l_quantity),6) iv
from lineitem join part on l_partkey=p_partkey""")
def ols_vs_iv_slope(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.select("l_extendedprice", "p_retailprice", "l_quantity", (F.col("p_retailprice") * F.col("l_quantity")).alias("z"))
    return j.agg(F.round(F.covar_samp("p_retailprice", "l_extendedprice") / F.var_samp("p_retailprice"), 6).alias("ols")).crossJoin(moments.instrument_slope(j, "l_quantity", "z", "l_extendedprice").select(F.round("iv", 6).alias("iv")))


@query("select p_size sigma, round((((sum(l_discount*l_quantity*l_quantity))/1000 - 50)/50)^2, 6) criterion from lineitem join part on l_partkey=p_partkey group by 1")
def sigma_criterion(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = moments.sigma_criterion(j.select(F.col("p_size").alias("sigma"), F.col("l_discount").alias("pi"), F.col("l_quantity").alias("size")), 50.0, 1000)
    return m.select("sigma", F.round("criterion", 6).alias("criterion"))


@query("select e1.l_orderkey a, e1.l_partkey b from (select distinct l_orderkey%200 l_orderkey, l_partkey%200 l_partkey from lineitem) e1 join (select distinct l_orderkey%200 l_orderkey, l_partkey%200 l_partkey from lineitem) e2 on e1.l_orderkey=e2.l_partkey and e1.l_partkey=e2.l_orderkey")
def reciprocal_edges(spark, d):
    e = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("a"), (F.col("l_partkey") % 200).alias("b")).distinct()
    return e.join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])


@query("with e as (select distinct l_orderkey a, l_partkey b from lineitem) select e1.a, e1.b from e e1 join e e2 on e1.a=e2.b and e1.b=e2.a")
def reciprocal_edges_whole(spark, d):
    """The real edges of the table; ``reciprocal_edges`` folds both ends by 200, as its SQL does."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return e.join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])


# -- replications --------------------------------------------------------------------------------------------------------------

def _boot(spark, d):
    v = [((F.col("c_custkey") * (31 + 7 * k)) % (97 + k)) / 64 for k in range(3)]
    return table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("rep_id"), (F.col("c_custkey") % 11 != 0).alias("converged"), F.array(*v).alias("theta"))


_BOOT = "bo as (select c_custkey rep_id, c_custkey%11<>0 converged, ((c_custkey*31)%97)/64.0::double t0, ((c_custkey*38)%98)/64.0::double t1, ((c_custkey*45)%99)/64.0::double t2 from customer)"


@query(f"with {_BOOT} select unnest([0,1,2])::int k, unnest([round(avg(t0),9), round(avg(t1),9), round(avg(t2),9)]) mean, unnest([round(stddev_samp(t0),9), round(stddev_samp(t1),9), round(stddev_samp(t2),9)]) se from bo where converged")
def bootstrap_mean_se(spark, d):
    b = _boot(spark, d)
    m = replications.mean(b, 3).select(F.posexplode("mean").alias("k", "mean"))
    s = replications.standard_errors(b, 3).select(F.posexplode("se").alias("k", "se"))
    return m.join(s, "k").select("k", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


@query(f"with {_BOOT}, l as (select rep_id, unnest([0,1,2])::int i, unnest([t0,t1,t2]) t from bo where converged) select a.i, b.i j, round(covar_samp(a.t,b.t),9) cov from l a join l b using (rep_id) group by 1,2")
def bootstrap_covariance(spark, d):
    return replications.covariance(_boot(spark, d), 3).select("i", "j", F.round("cov", 9).alias("cov"))


@query(f"with {_BOOT}, l as (select unnest([0,1,2])::int k, unnest([t0,t1,t2]) t from bo where converged) select k, round(quantile_cont(t,0.05),9) lower, round(quantile_cont(t,0.95),9) upper from l group by 1")
def bootstrap_percentile_ci(spark, d):
    return replications.interval(_boot(spark, d), 3, 0.9).select("k", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@query(f"with {_BOOT} select rep_id::int rep_id, t0 from bo union all select (rep_id+(select max(rep_id)+1 from bo))::int, t0 from bo")
def concat_replications(spark, d):
    b = _boot(spark, d)
    return replications.concatenated([b, b]).select("rep_id", item("theta", 0).alias("t0"))


def _steps(reps: int = 3) -> str:
    """Weights of replications: three keyed scrambling steps in 128-bit arithmetic, one select each."""
    m, last = "18446744073709551616::uhugeint", "s0"
    out = [f"s0 as (select c_custkey o, r, {draws.NAMESPACE}::uhugeint x from customer, (select unnest({list(range(reps))}) r))"]
    for i, key in enumerate(("5::uhugeint", "r::uhugeint", "o::uhugeint"), 1):
        out.append(f"a{i} as (select o, r, (xor(x, {key}) + {draws.INCREMENT}::uhugeint) % {m} z from {last})")
        out.append(f"b{i} as (select o, r, (xor(z, z >> 30) * {draws.MULTIPLIERS[0]}::uhugeint) % {m} z from a{i})")
        out.append(f"c{i} as (select o, r, (xor(z, z >> 27) * {draws.MULTIPLIERS[1]}::uhugeint) % {m} z from b{i})")
        out.append(f"s{i} as (select o, r, xor(z, z >> 31) x from c{i})")
        last = f"s{i}"
    out.append("draw as (select o, r, -ln(1 - (x >> 11)::double / 9007199254740992) e from s3)")
    return "with " + ", ".join(out) + " select r::int rep_id, o obs_id, round(e * count(*) over (partition by r) / sum(e) over (partition by r), 9) w from draw"


@query(_steps())
def bootstrap_weights(spark, d):
    return draws.observation_weights(_obs(spark, d).select("obs_id"), range(3), 5).select(F.col("rep_id").cast("int").alias("rep_id"), "obs_id", F.round("w", 9).alias("w"))


@query(_steps(4).replace("with ", f"with {ITEMS}, ", 1).rsplit(" select ", 1)[0] + """, share as (select r rep_id, o, e * count(*) over (partition by r) / sum(e) over (partition by r) w from draw)
 select rep_id, (k-1)::int pos, round(-sum(w*i.r*i.b),6) c from share join items i on i.a=o group by rep_id, k""")
def bootstrap_objectives(spark, d):
    o = _obs(spark, d)
    w = draws.observation_weights(o.select("obs_id"), range(4), 5)
    phi = o.select("obs_id", pricing.Modular(5).observed(o).alias("phi")).join(w, "obs_id")
    return moments.objective_coefficients(phi, 5, 1, "w", ("rep_id",)).select("rep_id", F.posexplode("c").alias("pos", "c")).select("rep_id", "pos", F.round("c", 6).alias("c"))


# -- fits ---------------------------------------------------------------------------------------------------------------------

# The value of a modular fit separates by item, and each part has its least value at a breakpoint or bound.
_CLOSED = f"""with {ITEMS}, p as (select distinct k, t from (select k, -nu/r t from items where abs(nu/r)<=10 union all select k, 10.0 from items union all select k, -10.0 from items)),
v as (select p.k, p.t, sum(greatest(r*p.t+nu,0) - r*b*p.t) v from p join items i on i.k=p.k group by 1,2)"""


def modular_fit(spark: SparkSession, d: str, formulation: str, **controls) -> fit.FitResult:
    obs = _obs(spark, d)
    return fit.estimate(fit.Model(pricing.Modular(5), BOX, formulation, 64), fit.Data(obs), tolerance=1e-7, publish=0, **controls)


@query(_CLOSED + " select round(sum(m),6) objective, (select count(*) from customer)::bigint n_agents, true converged from (select k, min(v) m from v group by k)")
def fit_modular_objective(spark, d):
    r = modular_fit(spark, d, fit.BLOCKSLACK)
    return r.to_df(spark).select(F.round("objective", 6).alias("objective"), F.lit(_n(spark, d)).cast("long").alias("n_agents"), "converged")


@query(_CLOSED + " select round(sum(m),6) objective, true converged from (select k, min(v) m from v group by k)")
def fit_by_agent_cuts(spark, d):
    return modular_fit(spark, d, fit.NSLACK).to_df(spark).select(F.round("objective", 6).alias("objective"), "converged")


@query(_CLOSED + " select round(sum(m),6) objective, true converged from (select k, min(v) m from v group by k)")
def fit_round_robin(spark, d):
    return modular_fit(spark, d, fit.NSLACK, schedule=schedules.RoundRobin(3)).to_df(spark).select(F.round("objective", 6).alias("objective"), "converged")


@query(_CLOSED + " select round(sum(m),6) objective, true converged from (select k, min(v) m from v group by k)")
def fit_penalised(spark, d):
    """The first programs hold theta near the one before; the last ones are linear, so the objective is that of any other fit."""
    r = modular_fit(spark, d, fit.BLOCKSLACK, qp_weight=0.5, qp_iterations=5, penalty_ref="dynamic")
    return r.to_df(spark).select(F.round("objective", 6).alias("objective"), "converged")


@query(None)
def fit_enumerated_kkt(spark, d):
    """Largest violation of the optimality conditions of a bundle fit: all close to 0."""
    import numpy as np

    o = _obs(spark, d).select("obs_id", F.slice("r", 1, 3).alias("x"), F.slice("nu", 1, 3).alias("nu"), F.slice("choice", 1, 3).alias("choice"))
    model = fit.Model(pricing.Enumerated(3), Parameters({"price": (-10.0, 10.0, 1), "item": (-10.0, 10.0, 3)}))
    r = fit.estimate(model, fit.Data(o), tolerance=1e-8, publish=fit.Publication.TABLE)
    c = -np.array(moments.sums(o.select(pricing.Enumerated(3).observed(o).alias("phi")), "phi", 4).first()["total"])
    weighted = [F.sum(F.col("pi") * item("phi", k)).alias(f"m{k}") for k in range(4)]
    row = r.cut_table.groupBy("agent_id").agg(F.sum("pi").alias("mass"), *weighted).agg(F.max("mass").alias("mass"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(4)]).first()
    r.close()
    left = c + np.array([row[f"m{k}"] or 0.0 for k in range(4)])
    bound = np.array([r.bound_duals.get(k, 0.0) for k in range(4)])
    over = max(0.0, (row["mass"] or 0.0) - 1)
    return spark.createDataFrame([(round(float(np.abs(left - bound).max()), 6), round(over, 6), r.converged)], "stationarity double, mass_over double, converged boolean")


@query(None)
def bootstrap_fit(spark, d):
    from .plans.bootstrap import bootstrap

    b = bootstrap(fit.Model(pricing.Modular(5), BOX, fit.BLOCKSLACK), fit.Data(_obs(spark, d)), 8, seed=5, tolerance=1e-6)
    return b.to_df(spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
