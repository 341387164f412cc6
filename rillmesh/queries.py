"""Named queries over the star-schema tables, one or more per operator, with their SQL.

Each query takes a session and a folder of Parquet tables and runs over whole tables.  The
SQL beside it says the same for an engine that is not this one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import asr, capture, layouts, predicates, provenance, reconcile, relational
from .operators.exchange import Exchange
from .operators.tables import PredicateRegistry, TableSet
from .plans import mappings, program, proql, unfold
from .plans.catalog import Field, Relation, System, TrustCondition
from .plans.compile import compile_rule, minus, union, within
from .plans.fixpoint import evaluate
from .sources import delimited
from .storage import run_dir
from .streaming.epochs import EpochLog, dump, restore
from .plans.rules import Rule, minimized, parse_rule, parse_rules, parse_tgd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables(dict):
    """Tables by name, opened when first used; only the path goes to Spark's reader."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder.rstrip("/")

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self[name]

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or name in NAMES


NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(sql: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a query under its function's name, with the SQL that gives its rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- rules


@query("SELECT DISTINCT c_custkey AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def rule_conjunctive_join(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(c, n, r) :- customer(c, _, k, _, _), nation(k, n, g), region(g, r)"), t)


@query("SELECT DISTINCT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING'")
def rule_constant_selection(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(c, b) :- customer(c, _, _, b, 'BUILDING')"), t)


@query("SELECT DISTINCT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey = n_regionkey")
def rule_repeated_var(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(k, n) :- nation(k, n, k)"), t)


@query("SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def rule_theta_join(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(a, b) :- nation(i, a, g), nation(j, b, g), COMPARE.INTLESS(i, j)"), t)


@query("SELECT DISTINCT l_orderkey AS o, l_linenumber AS i FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > p_retailprice AND p_size >= 25")
def rule_infix_comparison(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(o, i) :- lineitem(o, p, _, i, _, x, _, _, _, _, _), part(p, _, _, _, s, r), x > r, s >= 25"), t)


@query("SELECT DISTINCT a.r_name AS a, b.r_name AS b FROM region a, region b")
def rule_product(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(a, b) :- region(_, a), region(_, b)"), t)


@query("SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def rule_self_join(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(a, b) :- nation(_, a, g), nation(_, b, g)"), t)


@query("SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def rule_negation(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(c) :- customer(c, _, _, _, _), NOT_orders(_, c, 'F', _, _, _)"), t)


@query("SELECT DISTINCT n_name AS n, 'supplier' AS kind FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION SELECT DISTINCT n_name, 'customer' FROM nation JOIN customer ON c_nationkey = n_nationkey")
def rule_union_set(t: Tables) -> DataFrame:
    rules = parse_rules(["ans(n, 'supplier') :- nation(k, n, _), supplier(_, _, k, _)", "ans(n, 'customer') :- nation(k, n, _), customer(_, _, k, _, _)"])
    return union(rules, t).toDF("n", "kind")


@query("SELECT n_name AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey")
def rule_union_all(t: Tables) -> DataFrame:
    rules = parse_rules(["ans(n) :- nation(k, n, _), supplier(_, _, k, _)", "ans(n) :- nation(k, n, _), customer(_, _, k, _, _)"])
    return union(rules, t, distinct=False)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def rule_except(t: Tables) -> DataFrame:
    return t["customer"].select(F.col("c_custkey").alias("k")).subtract(t["orders"].where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rule_intersect(t: Tables) -> DataFrame:
    return t["customer"].select(F.col("c_nationkey").alias("k")).intersect(t["supplier"].select("s_nationkey"))


@query("SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def rule_semi(t: Tables) -> DataFrame:
    returned = t["lineitem"].where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return within(t["orders"], returned, ["o_orderkey"])


@query("SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def delete_by_query(t: Tables) -> DataFrame:
    gone = compile_rule(parse_rule("gone(o) :- lineitem(o, _, _, _, _, _, _, _, 'R', _, _)"), t)
    return minus(t["orders"], gone.toDF("o_orderkey"), ["o_orderkey"])


# ---------------------------------------------------------------- functions


@query("SELECT DISTINCT l_orderkey AS o, l_linenumber AS i, l_orderkey + l_linenumber AS s, l_orderkey - l_linenumber AS d, l_orderkey * l_linenumber AS m, l_orderkey // l_linenumber AS q FROM lineitem")
def fn_int_arith(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(o, i, s, d, m, q) :- lineitem(o, _, _, i, _, _, _, _, _, _, _), ARITH.INTADD(s, o, i), ARITH.INTSUB(d, o, i), ARITH.INTMUL(m, o, i), ARITH.INTDIV(q, o, i)"), t)


@query("SELECT DISTINCT p_partkey AS p, p_retailprice + p_size AS s, p_retailprice - p_size AS d, p_retailprice * p_size AS m, p_retailprice / p_size AS q FROM part WHERE p_size <> 0")
def fn_dbl_arith(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(p, s, d, m, q) :- part(p, _, _, _, z, r), z <> 0, ARITH.DBLADD(s, r, z), ARITH.DBLSUB(d, r, z), ARITH.DBLMUL(m, r, z), ARITH.DBLDIV(q, r, z)"), t)


@query("SELECT DISTINCT o_orderkey AS o, least(o_orderkey, o_custkey, 500) AS lo, greatest(o_orderkey, o_custkey) AS hi, CAST(o_orderkey + o_custkey AS DOUBLE) AS s FROM orders")
def fn_least_greatest(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(o, lo, hi, s) :- orders(o, c, _, _, _, _), ARITH.INTLEAST3(lo, o, c, 500), ARITH.INTGREATEST2(hi, o, c), ARITH.DBLSUM2(s, o, c)"), t)


@query("SELECT DISTINCT n_name || '@' AS a, substr(n_name, 2, 3) AS b, CAST(length(n_name) AS BIGINT) AS c FROM nation")
def fn_string(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(a, b, c) :- nation(_, n, _), STRING.STRCAT(a, n, '@'), STRING.SUBSTR(b, n, 2, 3), STRING.STRLEN(c, n)"), t)


@query("SELECT DISTINCT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment LIKE '%U%'")
def fn_strlike(t: Tables) -> DataFrame:
    return compile_rule(parse_rule("ans(c, s) :- customer(c, _, _, _, s), COMPARE.STRLIKE(s, '%U%')"), t)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal >= 1000.0 AND c_mktsegment <> 'BUILDING') OR NOT c_nationkey < 20")
def predicate_boolean(t: Tables) -> DataFrame:
    c = t["customer"]
    test = relational.any_of(relational.all_of(relational.compare(c, "c_acctbal", ">=", 1000.0), relational.compare(c, "c_mktsegment", "!=", "BUILDING")), ~relational.compare(c, "c_nationkey", "<", 20))
    return c.where(test).select("c_custkey", "c_acctbal")


# ---------------------------------------------------------------- aggregation, order, sets


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_discount) AS lo, max(l_tax) AS hi, avg(l_extendedprice) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100")
def agg_group_having(t: Tables) -> DataFrame:
    return relational.group(t["lineitem"], ["l_returnflag", "l_linestatus"], {"n": F.count("*"), "qty": F.sum("l_quantity"), "lo": F.min("l_discount"), "hi": F.max("l_tax"), "price": F.avg("l_extendedprice")}, F.col("n") > 100)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer ORDER BY bal DESC NULLS LAST, c_custkey")
def sort_nulls(t: Tables) -> DataFrame:
    rows = t["customer"].select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    return relational.ordered(rows, [("bal", "desc", "last"), ("c_custkey", "asc", "first")])


@query("SELECT 'region' AS table_name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def count_tables(t: Tables) -> DataFrame:
    return relational.counts({n: t[n] for n in ("region", "nation", "orders")})


@query("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) + (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) AS n")
def table_compare(t: Tables) -> DataFrame:
    a, b = t["customer"].select("c_nationkey"), t["supplier"].select("s_nationkey")
    return a.subtract(b).unionByName(b.toDF("c_nationkey").subtract(a)).agg(F.count("*").alias("n"))


@query("SELECT s_nationkey AS k, s_name AS sname, NULL AS cname, 'S' AS MRULE FROM supplier UNION ALL SELECT c_nationkey, NULL, c_name, 'C' FROM customer")
def outer_union(t: Tables) -> DataFrame:
    return relational.outer_union({"S": t["supplier"].select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("sname")), "C": t["customer"].select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("cname"))})


# ---------------------------------------------------------------- recursion

_NEXT = "SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders"


def _chain(t: Tables) -> DataFrame:
    """Each order with its customer's next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t["orders"].select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b is not null")


@query(f"WITH RECURSIVE e AS (SELECT * FROM ({_NEXT}) WHERE b IS NOT NULL), tc(x, y) AS (SELECT a, b FROM e UNION SELECT tc.x, e.b FROM tc JOIN e ON tc.y = e.a) SELECT x, y FROM tc")
def fixpoint_closure(t: Tables) -> DataFrame:
    return evaluate(parse_rules(["tc(x, y) :- e(x, y)", "tc(x, z) :- tc(x, y), tc(y, z)"]), {"e": _chain(t)})["tc"]


@query("""WITH RECURSIVE p(c, q) AS (SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
sg(x, y) AS (SELECT a.c, b.c FROM p a JOIN p b ON a.q = b.q UNION SELECT a.c, b.c FROM sg JOIN p a ON a.q = sg.x JOIN p b ON b.q = sg.y) SELECT x, y FROM sg""")
def fixpoint_same_generation(t: Tables) -> DataFrame:
    s = t["supplier"].select(F.concat(F.lit("s"), "s_suppkey").alias("c"), F.concat(F.lit("n"), "s_nationkey").alias("q"))
    n = t["nation"].select(F.concat(F.lit("n"), "n_nationkey").alias("c"), F.concat(F.lit("r"), "n_regionkey").alias("q"))
    return evaluate(parse_rules(["sg(x, y) :- p(x, q), p(y, q)", "sg(x, y) :- p(x, a), sg(a, b), p(y, b)"]), {"p": s.unionByName(n)}, lean=True)["sg"]


@query(f"WITH RECURSIVE e AS (SELECT * FROM ({_NEXT}) WHERE b IS NOT NULL), seen(x) AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT b FROM seen JOIN e ON x = a) SELECT o_orderkey AS x FROM orders WHERE o_orderkey NOT IN (SELECT x FROM seen)")
def stratified_negation(t: Tables) -> DataFrame:
    tables = {"e": _chain(t), "orders": t["orders"]}
    return evaluate(parse_rules(["seen(x) :- orders(x, _, _, _, _, '1-URGENT')", "seen(y) :- seen(x), e(x, y)", "rest(x) :- orders(x, _, _, _, _, _), NOT_seen(x)"]), tables)["rest"]


@query(f"WITH RECURSIVE e AS (SELECT * FROM ({_NEXT}) WHERE b IS NOT NULL), big(x) AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 UNION SELECT b FROM big JOIN e ON x = a) SELECT x, o_custkey AS c FROM big JOIN orders ON x = o_orderkey")
def program_text(t: Tables) -> DataFrame:
    text = """
    -- orders that follow a large one
    big(x) :- orders(x, _, _, p, _, _), p > 100000
    * big(y) :- big(x), e(x, y).
    ans(x, c) :- big(x), orders(x, c, _, _, _, _)
    """
    return program.run(text, {"orders": t["orders"], "e": _chain(t)})


@query("SELECT DISTINCT r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 5000 UNION SELECT DISTINCT r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000")
def unfolded_views(t: Tables) -> DataFrame:
    text = """
    rich(k) :- supplier(_, _, k, b), b > 5000
    rich(k) :- customer(_, _, k, b, _), b > 9000
    place(k, r) :- nation(k, _, g), region(g, r)
    ans(r) :- rich(k), place(k, r)
    """
    return program.run_unfolded(text, t)


# ---------------------------------------------------------------- access-support relations


def _paths(t: Tables) -> list[DataFrame]:
    m1 = t["region"].select(F.col("r_regionkey").alias("g"), "r_name")
    m2 = t["nation"].where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("g"))
    m3 = t["supplier"].where("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return [m1, m2, m3]


_PATHS = "WITH m1 AS (SELECT r_regionkey AS g, r_name FROM region), m2 AS (SELECT n_nationkey AS k, n_regionkey AS g FROM nation WHERE n_nationkey < 20), m3 AS (SELECT s_suppkey, s_nationkey AS k FROM supplier WHERE s_acctbal > 0) "


@query(_PATHS + "SELECT DISTINCT g, r_name, k, s_suppkey FROM m1 JOIN m2 USING (g) JOIN m3 USING (k)")
def asr_inner(t: Tables) -> DataFrame:
    return asr.inner(_paths(t))


@query(_PATHS + "SELECT DISTINCT g, r_name, k, s_suppkey FROM m1 LEFT JOIN m2 USING (g) LEFT JOIN m3 USING (k)")
def asr_left(t: Tables) -> DataFrame:
    return asr.real(_paths(t), "left")


@query(_PATHS + "SELECT DISTINCT g, r_name, k, s_suppkey FROM m1 RIGHT JOIN m2 USING (g) RIGHT JOIN m3 USING (k)")
def asr_right(t: Tables) -> DataFrame:
    return asr.real(_paths(t), "right")


@query(_PATHS + "SELECT DISTINCT g, r_name, k, s_suppkey FROM m1 FULL JOIN m2 USING (g) FULL JOIN m3 USING (k)")
def asr_full(t: Tables) -> DataFrame:
    return asr.real(_paths(t), "full")


_SIM = {"left": "SELECT DISTINCT g, r_name, k, NULL::BIGINT AS s_suppkey FROM m1 JOIN m2 USING (g)", "right": "SELECT DISTINCT g, NULL AS r_name, k, s_suppkey FROM m2 JOIN m3 USING (k)", "all": "SELECT DISTINCT g, r_name, k, s_suppkey FROM m1 JOIN m2 USING (g) JOIN m3 USING (k)"}


@query(_PATHS + f"{_SIM['left']} UNION {_SIM['all']}")
def asr_simulated_left(t: Tables) -> DataFrame:
    return asr.simulated(_paths(t), "left")


@query(_PATHS + f"{_SIM['right']} UNION {_SIM['all']}")
def asr_simulated_right(t: Tables) -> DataFrame:
    return asr.simulated(_paths(t), "right")


@query(_PATHS + f"{_SIM['left']} UNION {_SIM['right']} UNION {_SIM['all']}")
def asr_simulated_full(t: Tables) -> DataFrame:
    return asr.simulated(_paths(t), "full")


# ---------------------------------------------------------------- mappings and exchange


def _system() -> System:
    """Two source peers and a target peer that joins them."""
    s = System("exchange")
    s.add(Relation("Shop", "s", "C", (Field("c", "LONG", True, labeled=False), Field("k", "INT", labeled=False))))
    s.add(Relation("Geo", "s", "N", (Field("k", "INT", True, labeled=False), Field("n", "VARCHAR(25)", labeled=False), Field("g", "INT", labeled=False))))
    s.add(Relation("Hub", "s", "CG", (Field("c", "LONG", True, labeled=False), Field("g", "INT", labeled=False))))
    s.add(Relation("Hub", "s", "Seen", (Field("g", "INT", True, labeled=False),)))
    s.mappings = [parse_tgd("CG(c, g) :- C(c, k), N(k, n, g)", "M0"), parse_tgd("Seen(g) :- CG(c, g)", "M1")]
    return s


def _sources(t: Tables) -> dict[str, DataFrame]:
    return {"C": t["customer"].select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("k")), "N": t["nation"].select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"), F.col("n_regionkey").alias("g"))}


_CG = "SELECT DISTINCT c_custkey AS c, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(_CG)
def exchange_recompute(t: Tables) -> DataFrame:
    x = Exchange(t.spark, _system())
    return x.rows(x.recompute(x.start(_sources(t))), "CG")


@query(_CG)
def exchange_insert_delta(t: Tables) -> DataFrame:
    x, src = Exchange(t.spark, _system()), _sources(t)
    state = x.recompute(x.start({"C": src["C"].where("c % 3 <> 0"), "N": src["N"]}))
    return x.rows(x.insert(state, {"C": src["C"].where("c % 3 = 0")}), "CG")


@query(_CG + " WHERE n_nationkey >= 5 AND c_custkey % 3 <> 0")
def exchange_delete_delta(t: Tables) -> DataFrame:
    x, src = Exchange(t.spark, _system()), _sources(t)
    state = x.recompute(x.start(src))
    return x.rows(x.delete(state, {"C": src["C"].where("c % 3 = 0"), "N": src["N"].where("k < 5")}), "CG")


@query(f"SELECT DISTINCT g FROM ({_CG}) WHERE g <> 2")
def exchange_rejection(t: Tables) -> DataFrame:
    x, src = Exchange(t.spark, _system()), _sources(t)
    state = x.recompute(x.start(src))
    no = src["N"].where("g = 2").select("g").distinct()
    return x.rows(x.delete(state, {}, {"Seen": no}), "Seen")


@query("SELECT DISTINCT c_custkey AS c, c_nationkey AS k, n_name AS n, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey")
def exchange_provenance_relation(t: Tables) -> DataFrame:
    x = Exchange(t.spark, _system())
    return x.rows(x.recompute(x.start(_sources(t))), "PROV.M0")


@query("SELECT c_mktsegment AS s, count(DISTINCT c_custkey) AS n, 1::BIGINT AS nulls FROM customer GROUP BY c_mktsegment")
def mapping_skolem_shared_null(t: Tables) -> DataFrame:
    """Customers of a segment share the labeled null that stands for its manager."""
    s = System("skolem")
    s.add(Relation("A", "s", "Cust", (Field("c", "LONG", labeled=False), Field("seg", "VARCHAR(10)", labeled=False))))
    s.add(Relation("B", "s", "Seg", (Field("seg", "VARCHAR(10)"), Field("mgr", "VARCHAR(10)"))))
    s.add(Relation("B", "s", "Rep", (Field("c", "LONG"), Field("mgr", "VARCHAR(10)"))))
    s.mappings = [parse_tgd("Seg(s, m) :- Cust(c, s)", "seg"), parse_tgd("Rep(c, m) :- Cust(c, s), Seg(s, m)", "rep")]
    x = Exchange(t.spark, s)
    state = x.recompute(x.start({"Cust": t["customer"].select(F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("seg"))}))
    seg, rep = x.rows(state, "Seg"), x.rows(state, "Rep")
    joined = rep.join(seg, "mgr_LN")
    return joined.groupBy(F.col("seg").alias("s")).agg(F.count_distinct("c").alias("n"), F.count_distinct("mgr_LN").alias("nulls"))


@query("SELECT DISTINCT n_nationkey AS k, n_regionkey AS g FROM nation")
def mapping_bidirectional(t: Tables) -> DataFrame:
    """The inverse of a copy mapping carries target rows back to the source."""
    s = System("both")
    pair = (Field("k", "INT", True, labeled=False), Field("g", "INT", labeled=False))
    s.add(Relation("A", "s", "X", pair))
    s.add(Relation("B", "s", "Y", pair))
    s.mappings = [parse_tgd("Y(k, g) :- X(k, g)", "copy", bidirectional=True)]
    x = Exchange(t.spark, s, check_acyclic=True)
    rows = t["nation"].select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("g"))
    return x.rows(x.recompute(x.start({"X": rows.where("k % 2 = 0"), "Y": rows.where("k % 2 = 1")})), "X")


@query(f"SELECT c, g, CASE WHEN c % 2 = 0 THEN 3 ELSE 2 END AS Hub_TRUST FROM ({_CG})")
def exchange_trust_annotations(t: Tables) -> DataFrame:
    s = _system()
    s.trust = [TrustCondition("Hub", "C", "Shop", 3, "c % 2 = 0"), TrustCondition("Hub", "C", "Shop", 2), TrustCondition("Hub", "N", "Geo", 9)]
    x = Exchange(t.spark, s)
    return x.annotated(x.recompute(x.start(_sources(t))), "CG", "Hub")


# ---------------------------------------------------------------- capture


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    now = t["orders"].where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    before = t["orders"].where("o_orderkey % 10 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return now, before


_SNAP = "WITH n AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0) "


@query(_SNAP + "SELECT * FROM n EXCEPT SELECT * FROM b")
def capture_inserts(t: Tables) -> DataFrame:
    return capture.changes(*_snapshots(t))[0]


@query(_SNAP + "SELECT * FROM b EXCEPT SELECT * FROM n")
def capture_deletes(t: Tables) -> DataFrame:
    return capture.changes(*_snapshots(t))[1]


@query(_SNAP + """, i AS (SELECT * FROM n EXCEPT SELECT * FROM b), d AS (SELECT * FROM b EXCEPT SELECT * FROM n)
SELECT 'local_ins' AS kind, * FROM i UNION ALL SELECT 'local_del', * FROM d WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'reject_ins', * FROM d WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'reject_del', * FROM i WHERE o_orderkey % 4 = 0""")
def apply_updates(t: Tables) -> DataFrame:
    ins, dele = capture.changes(*_snapshots(t))
    local, derivable, rejected = dele.where("o_orderkey % 2 = 0"), dele.where("o_orderkey % 3 = 0"), ins.where("o_orderkey % 4 = 0")
    u = capture.routed(ins, dele, local, rejected, derivable)
    return relational.outer_union({"local_ins": u.local_ins, "local_del": u.local_del, "reject_ins": u.reject_ins, "reject_del": u.reject_del}, "kind")


# ---------------------------------------------------------------- provenance


def _views() -> tuple[Rule, list[Rule]]:
    views = [parse_rule("placed(g, s) :- nation(k, _, g), supplier(s, _, k, b)", "m1"), parse_rule("placed(g, c) :- nation(k, _, g), customer(c, _, k, b, 'BUILDING')", "m2")]
    return parse_rule("ans(g) :- placed(g, x)", "q"), views


_DERIVED = "WITH d AS (SELECT n_regionkey AS g, n_nationkey AS k, s_suppkey AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT n_regionkey, n_nationkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING') "


def _valued(t: Tables, text: str) -> DataFrame:
    q, views = _views()
    return provenance.evaluate(q, views, t, *provenance.parse_assignment(text))


@query(_DERIVED + "SELECT g, CAST(sum(2 * (k + 1)) AS BIGINT) AS PROV__ FROM d GROUP BY g")
def prov_multiplicity(t: Tables) -> DataFrame:
    return _valued(t, "EVALUATE MULTIPLICITY ASSIGNING EACH CASE nation SET cast($$.n_nationkey + 1 as bigint) DEFAULT SET 2")


@query(_DERIVED + "SELECT g, CAST(max(k + 1) AS BIGINT) AS PROV__ FROM d GROUP BY g")
def prov_trust(t: Tables) -> DataFrame:
    return _valued(t, "EVALUATE TRUST ASSIGNING EACH CASE nation SET cast($$.n_nationkey + 1 as bigint) DEFAULT SET cast(1 as bigint)")


@query(_DERIVED + "SELECT g, CAST(min(k + 5) AS BIGINT) AS PROV__ FROM d GROUP BY g")
def prov_weight(t: Tables) -> DataFrame:
    return _valued(t, "EVALUATE WEIGHT ASSIGNING EACH CASE nation SET cast($$.n_nationkey as bigint) DEFAULT SET cast(5 as bigint)")


@query(_DERIVED + "SELECT g, CAST(max(k + s) AS BIGINT) AS PROV__ FROM d GROUP BY g")
def prov_tropical_max(t: Tables) -> DataFrame:
    return _valued(t, "EVALUATE MAX ASSIGNING EACH CASE nation SET cast($$.n_nationkey as bigint) CASE supplier SET $$.s_suppkey CASE customer SET $$.c_custkey")


@query(_DERIVED + "SELECT g, CAST(min(k + s) AS BIGINT) AS PROV__ FROM d GROUP BY g")
def prov_tropical_min(t: Tables) -> DataFrame:
    return _valued(t, "EVALUATE MIN ASSIGNING EACH CASE nation SET cast($$.n_nationkey as bigint) CASE supplier SET $$.s_suppkey CASE customer SET $$.c_custkey")


@query("SELECT r_name AS r, string_agg('m(nation(' || n_nationkey || ',' || n_name || ',' || n_regionkey || ') * region(' || r_regionkey || ',' || r_name || '))', ' + ' ORDER BY 'm(nation(' || n_nationkey || ',' || n_name || ',' || n_regionkey || ') * region(' || r_regionkey || ',' || r_name || '))') AS PROV__ FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def prov_polynomial(t: Tables) -> DataFrame:
    return provenance.polynomial(parse_rule("ans(r) :- located(n, r)", "q"), [parse_rule("located(n, r) :- nation(k, n, g), region(g, r)", "m")], t)


def _proql(t: Tables, text: str, root: str) -> DataFrame:
    system = _system()
    src = _sources(t)
    empty = {"CG": t.spark.createDataFrame([], "c long, g int"), "Seen": t.spark.createDataFrame([], "g int")}
    return proql.run(text, system, src | empty)[f"Hub.s.{root}"]


@query(f"SELECT c, g, count(*) AS PROV__ FROM (SELECT c_custkey AS c, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY c, g")
def proql_step(t: Tables) -> DataFrame:
    return _proql(t, "[Hub.s.CG $x] <M0 - [C] EVALUATE MULTIPLICITY ASSIGNING EACH DEFAULT SET cast(1 as bigint)", "CG")


@query("SELECT n_regionkey AS g, count(*) AS PROV__ FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def proql_chain(t: Tables) -> DataFrame:
    return _proql(t, "[Seen $x] *- [N] EVALUATE MULTIPLICITY ASSIGNING EACH DEFAULT SET cast(1 as bigint)", "Seen")


# ---------------------------------------------------------------- reconciliation


def _log(t: Tables) -> DataFrame:
    """Every event as a transaction that sets its user's value; events of a type are a peer's."""
    none = F.lit(None).cast("struct<user_id:bigint,value:double>")
    return t["events"].select(F.col("event_id").cast("string").alias("txn"), F.col("event_type").alias("peer"), F.lit(1).alias("seq"), F.lit("profile").alias("relation"), none.alias("old"), F.struct("user_id", "value").alias("new"), F.array().cast("array<string>").alias("prev"))


@query("SELECT user_id AS key, count(DISTINCT value) AS options, count(*) AS txns FROM events GROUP BY user_id HAVING count(DISTINCT value) > 1")
def reconcile_conflicts_key(t: Tables) -> DataFrame:
    g = reconcile.conflict_groups(reconcile.flatten(_log(t), ["user_id"]))
    return g.where("kind = 'KEY'").groupBy(F.get_json_object("about", "$.user_id").cast("bigint").alias("key")).agg(F.count("*").alias("options"), F.sum(F.size("txns")).alias("txns"))


@query("SELECT event_type AS peer, count(*) AS n, max(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END) AS priority FROM events GROUP BY event_type")
def reconcile_priority(t: Tables) -> DataFrame:
    trust = [TrustCondition("me", "profile", "click", 3), TrustCondition("me", "profile", "view", 2)]
    flat = reconcile.flatten(_log(t), ["user_id"])
    ranked = reconcile.priorities(flat, "me", trust)
    return flat.select("txn", "peer").distinct().join(ranked, "txn").groupBy("peer").agg(F.count("*").alias("n"), F.max("priority").alias("priority"))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END AS p FROM events),
u AS (SELECT user_id, max(p) AS top, count(DISTINCT value) FILTER (p = 3) AS n3, count(DISTINCT value) FILTER (p = 2) AS n2 FROM e WHERE p > 0 GROUP BY user_id),
s AS (SELECT e.*, n3, n2, (SELECT min(value) FROM e x WHERE x.user_id = e.user_id AND x.p = 3) AS v3 FROM e JOIN u USING (user_id) WHERE p > 0)
SELECT CAST(event_id AS VARCHAR) AS txn, p AS priority, CASE WHEN p = 3 AND n3 > 1 THEN 'DEFER' WHEN p = 3 THEN 'ACCEPT'
 WHEN n3 = 1 AND v3 <> value THEN 'REJECT' WHEN n3 > 1 THEN 'DEFER' WHEN n2 > 1 THEN 'DEFER' ELSE 'ACCEPT' END AS status FROM s""")
def reconcile_decide(t: Tables) -> DataFrame:
    trust = [TrustCondition("me", "profile", "click", 3), TrustCondition("me", "profile", "view", 2)]
    return reconcile.Reconciler(t.spark, "me", ["user_id"], trust).reconcile(_log(t)).statuses.drop("cause")


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END AS p FROM events),
u AS (SELECT user_id, count(DISTINCT value) FILTER (p = 3) AS n3, count(DISTINCT value) FILTER (p = 2) AS n2, min(value) FILTER (p = 3) AS v3 FROM e GROUP BY user_id)
SELECT CAST(event_id AS VARCHAR) AS txn, CASE WHEN p = 0 THEN 'UNKNOWN' WHEN p = 3 AND n3 > 1 THEN 'DEFERCONFLICT' WHEN p = 3 THEN 'ACCEPT'
 WHEN n3 = 1 AND v3 <> value THEN 'REJECTCONFLICT' WHEN n3 > 1 OR n2 > 1 THEN 'DEFERCONFLICT' ELSE 'ACCEPT' END AS status FROM e JOIN u USING (user_id)""")
def reconcile_statuses(t: Tables) -> DataFrame:
    trust = [TrustCondition("me", "profile", "click", 3), TrustCondition("me", "profile", "view", 2)]
    d = reconcile.Reconciler(t.spark, "me", ["user_id"], trust).reconcile(_log(t))
    return reconcile.detailed(d.statuses).select("txn", "status").unionByName(d.unknown.withColumn("status", F.lit("UNKNOWN")))


@query("SELECT user_id, min(value) AS value FROM events WHERE event_id < 500 AND event_type = 'click' GROUP BY user_id HAVING count(DISTINCT value) = 1")
def reconcile_state_at(t: Tables) -> DataFrame:
    """The state after the first of two reconciliations, read after the second."""
    r = reconcile.Reconciler(t.spark, "me", ["user_id"], [TrustCondition("me", "profile", "click", 3)])
    log = _log(t)
    r.reconcile(log.where(F.col("txn").cast("bigint") < 500))
    r.reconcile(log)
    return r.state_at(1).select("value.user_id", "value.value")


@query("SELECT user_id AS key, count(DISTINCT value) FILTER (event_id % 5 <> 0) + 1 AS options, count(*) AS txns FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 5 = 0) > 0 AND count(*) FILTER (event_id % 5 <> 0) > 0")
def reconcile_conflicts_update(t: Tables) -> DataFrame:
    """All events of a user change the same old row, every fifth by deleting it."""
    kind = "struct<user_id:bigint,value:double>"
    gone = F.col("txn").cast("bigint") % 5 == 0
    log = _log(t).withColumn("old", F.struct(F.col("new.user_id"), F.lit(-1.0).alias("value")).cast(kind)).withColumn("new", F.when(~gone, F.col("new")))
    g = reconcile.conflict_rows(reconcile.flatten(log, ["user_id"])).where("kind = 'UPDATE'")
    return g.groupBy(F.get_json_object("about", "$.user_id").cast("bigint").alias("key")).agg(F.count_distinct("option").alias("options"), F.count("*").alias("txns"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'p' ELSE 'q' END || c_custkey AS txn, c_custkey AS k, CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END AS before, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS after
FROM customer WHERE c_custkey % 3 <> 0 OR c_nationkey >= 12""")
def reconcile_needed_updates(t: Tables) -> DataFrame:
    """Customers' rows go from 0 to 1 by p and on to 2 by q; p has been applied in twelve nations."""
    row = lambda v: F.struct(F.col("c_custkey").alias("k"), v.cast("int").alias("v"))
    first = F.col("c_custkey") % 3 == 0
    p, q = F.concat(F.lit("p"), "c_custkey"), F.concat(F.lit("q"), "c_custkey")
    rest = [F.lit("r").alias("relation"), F.struct(F.col("c_custkey").alias("k")).alias("key"), row(F.lit(0)).alias("old")]
    done = t["customer"].where("c_nationkey < 12").select(p.alias("txn"), *rest, row(F.lit(1)).alias("new"))
    asked = t["customer"].select(F.when(first, p).otherwise(q).alias("txn"), *rest, row(F.when(first, 1).otherwise(2)).alias("new"))
    needs = t["customer"].select(q.alias("txn"), p.alias("needs"))
    return reconcile.needed_updates(asked, done, needs).select("txn", "key.k", F.col("old.v").alias("before"), F.col("new.v").alias("after"))


def _edits(t: Tables) -> DataFrame:
    """A user's events in order: the first inserts the row, each later one changes it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t["events"].withColumn("before", F.lag("value").over(w)).withColumn("n", F.row_number().over(w))
    kind = "struct<user_id:bigint,value:double>"
    return rows.select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("txn"), F.lit("p").alias("peer"), F.col("event_id").alias("seq"), F.lit("profile").alias("relation"), F.when(F.col("n") > 1, F.struct("user_id", F.col("before").alias("value"))).cast(kind).alias("old"), F.struct("user_id", "value").cast(kind).alias("new"), F.array().cast("array<string>").alias("prev"))


@query("SELECT 'u' || (user_id % 50) AS txn, user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def flatten_updates(t: Tables) -> DataFrame:
    flat = reconcile.flatten(_edits(t), ["user_id"])
    return flat.select("txn", F.col("key.user_id").alias("user_id"), F.col("new.value").alias("value"))


@query(f"WITH RECURSIVE e AS (SELECT a, b FROM ({_NEXT}) WHERE b IS NOT NULL), n(txn, needs) AS (SELECT b, a FROM e UNION SELECT n.txn, e.a FROM n JOIN e ON n.needs = e.b) SELECT CAST(txn AS VARCHAR) AS txn, CAST(needs AS VARCHAR) AS needs FROM n")
def reconcile_antecedents(t: Tables) -> DataFrame:
    log = _chain(t).select(F.col("b").cast("string").alias("txn"), F.array(F.col("a").cast("string")).alias("prev"))
    return reconcile.antecedents(log)


@query("SELECT user_id, value, epoch AS since, lead(epoch) OVER (PARTITION BY user_id ORDER BY epoch) AS until FROM (SELECT user_id, event_id // 100 AS epoch, arg_max(value, event_id) AS value FROM events GROUP BY ALL)")
def log_versions(t: Tables) -> DataFrame:
    rows = _edits(t).withColumn("epoch", F.call_function("div", F.col("seq"), F.lit(100)))
    got = reconcile.versions(rows, ["user_id"])
    return got.select("key.user_id", "value.value", "since", "until")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id >= 500 GROUP BY user_id HAVING NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = events.user_id AND e.event_id < 500)")
def log_net_insertions(t: Tables) -> DataFrame:
    rows = _edits(t).withColumn("epoch", F.when(F.col("seq") >= 500, 2).otherwise(1))
    ins, gone = reconcile.to_deltas(rows, "profile", ["user_id"], after=1)
    return minus(ins, gone, ["user_id"])


# ---------------------------------------------------------------- predicates, tables, layouts


@query("SELECT s_suppkey AS s, c_custkey AS c FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) < 50")
def join_user_predicate_left(t: Tables) -> DataFrame:
    known = PredicateRegistry()
    known.register("near", lambda a, b: F.abs(a - b) < 50)
    s = t["supplier"].select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("b"))
    c = t["customer"].select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b"))
    return known.join(s, c, "near", ["b"], ["b"], "left", equal=["k"]).select(F.col("s_suppkey").alias("s"), F.col("c_custkey").alias("c"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_name LIKE '%9')")
def predicate_tests(t: Tables) -> DataFrame:
    p = predicates.All((predicates.Test("c_acctbal", "between", (0, 5000)), predicates.Any((predicates.Test("c_mktsegment", "in", ("BUILDING", "MACHINERY")), predicates.Test("c_name", "like", ("%9",))))))
    return predicates.selected(t["customer"], predicates.from_xml(predicates.to_xml(p))).select("c_custkey")


@query("SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT DISTINCT c_custkey FROM customer WHERE c_nationkey < 5")
def table_insert_set(t: Tables) -> DataFrame:
    known = TableSet(t.spark, {"k": t["orders"].select(F.col("o_custkey").alias("k")).distinct()})
    known.insert("k", t["customer"].where("c_nationkey < 5").select(F.col("c_custkey").alias("k")))
    return known["k"]


@query("SELECT 'M0' AS MRULE, count(*) AS n FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey) UNION ALL SELECT 'M1', count(*) FROM (" + _CG + ")")
def provenance_outer_union(t: Tables) -> DataFrame:
    x = Exchange(t.spark, _system())
    state = x.recompute(x.start(_sources(t)))
    wide = layouts.outer_union({"M0": x.rows(state, "PROV.M0"), "M1": x.rows(state, "PROV.M1")})
    return wide.groupBy("MRULE").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION SELECT -c_custkey, c_custkey FROM customer WHERE c_nationkey = 4")
def table_rule_updates(t: Tables) -> DataFrame:
    known = TableSet(t.spark, {"o": t["orders"].select("o_orderkey", "o_custkey"), "c": t["customer"].select("c_custkey", "c_nationkey")})
    known.apply("NOT_o(k, c) :- o(k, c), c(c, 3)")
    known.apply("o(k, c) :- c(c, 4), ARITH.INTSUB(k, 0, c)")
    return known["o"]


# ---------------------------------------------------------------- every arity and type of the scalar functions


def _measured(t: Tables, atoms: str) -> DataFrame:
    t["m"] = t["lineitem"].select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("i"), "l_suppkey", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"))
    return compile_rule(parse_rule(f"ans(o, i, r2, r3, r4, r5, r6, r7) :- m(o, i, s, p, q, d, x), {atoms}"), t)


def _arities(name: str, inputs: list[str]) -> str:
    return ", ".join(f"ARITH.{name}{n}(r{n}, {', '.join(inputs[:n])})" for n in range(2, 8))


def _arities_sql(function: str, inputs: list[str]) -> str:
    made = ", ".join(f"{function}({', '.join(inputs[:n])}) AS r{n}" for n in range(2, 8))
    return f"SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS i, {made} FROM lineitem"


_INTS, _INTS_SQL = ["s", "p", "i", "o", "s", "p", "i"], [f"CAST({c} AS BIGINT)" for c in ("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")]
_DBLS, _DBLS_SQL = ["q", "d", "x", "q", "d", "x", "q"], ["l_quantity", "l_discount", "l_tax", "l_quantity", "l_discount", "l_tax", "l_quantity"]


@query(_arities_sql("least", _INTS_SQL))
def fn_int_least_arities(t: Tables) -> DataFrame:
    return _measured(t, _arities("INTLEAST", _INTS))


@query(_arities_sql("greatest", _INTS_SQL))
def fn_int_greatest_arities(t: Tables) -> DataFrame:
    return _measured(t, _arities("INTGREATEST", _INTS))


@query(_arities_sql("least", _DBLS_SQL))
def fn_dbl_least_arities(t: Tables) -> DataFrame:
    return _measured(t, _arities("DBLLEAST", _DBLS))


@query("SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS i, " + ", ".join(f"{' + '.join(_DBLS_SQL[:n])} AS r{n}" for n in range(2, 8)) + " FROM lineitem")
def fn_dbl_sum_arities(t: Tables) -> DataFrame:
    return _measured(t, _arities("DBLSUM", _DBLS))


@query("SELECT DISTINCT o_orderkey AS k, o_orderstatus = 'F' AND o_totalprice > 100000 AS a, o_orderstatus = 'F' OR o_totalprice > 100000 AS b FROM orders")
def fn_bits(t: Tables) -> DataFrame:
    t["flags"] = t["orders"].select("o_orderkey", (F.col("o_orderstatus") == "F").alias("f"), (F.col("o_totalprice") > 100000).alias("p"))
    return compile_rule(parse_rule("ans(k, a, b) :- flags(k, f, p), ARITH.BITAND(a, f, p), ARITH.BITOR(b, f, p)"), t)


_SIX = {"LESS": "<", "LESSEQUAL": "<=", "GREATER": ">", "GREATEREQUAL": ">=", "EQUAL": "=", "NOTEQUAL": "<>"}


@query(" UNION ".join(f"SELECT '{n}' AS test, p_partkey AS k FROM part WHERE p_size {op} 20" for n, op in _SIX.items()))
def compare_int_all(t: Tables) -> DataFrame:
    return union(parse_rules([f"ans('{n}', k) :- part(k, _, _, _, s, _), COMPARE.INT{n}(s, 20)" for n in _SIX]), t).toDF("test", "k")


@query(" UNION ".join(f"SELECT '{n}' AS test, l_orderkey AS o, l_linenumber AS i FROM lineitem WHERE l_discount {op} l_tax" for n, op in _SIX.items()))
def compare_dbl_all(t: Tables) -> DataFrame:
    return union(parse_rules([f"ans('{n}', o, i) :- lineitem(o, _, _, i, _, _, d, x, _, _, _), COMPARE.DBL{n}(d, x)" for n in _SIX]), t).toDF("test", "o", "i")


# ---------------------------------------------------------------- rewrites of rules, tested by what they compute


@query("SELECT DISTINCT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rule_minimized(t: Tables) -> DataFrame:
    rule = minimized(parse_rule("ans(c, n) :- customer(c, x, k, b, s), nation(k, n, g), customer(c, x, k, b, s), nation(k, n, g)"))
    assert len(rule.body) == 2
    return compile_rule(rule, t)


@query("SELECT true AS chain, false AS feeds_itself")
def mapping_weak_acyclicity(t: Tables) -> DataFrame:
    chain = [parse_tgd("b(x, y) :- a(x)"), parse_tgd("c(y) :- b(x, y)")]
    cycle = [parse_tgd("b(x, y) :- a(x)"), parse_tgd("a(y) :- b(x, y)")]
    return t.spark.createDataFrame([(mappings.weakly_acyclic(chain), mappings.weakly_acyclic(cycle))], "chain boolean, feeds_itself boolean")


@query("SELECT true AS closure, false AS steps")
def program_recursion_test(t: Tables) -> DataFrame:
    closure = parse_rules(["p(x, y) :- e(x, y)", "p(x, z) :- p(x, y), e(y, z)"])
    steps = parse_rules(["p(x, y) :- e(x, y)", "q(x, z) :- p(x, y), e(y, z)"])
    return t.spark.createDataFrame([(unfold.is_recursive(closure, "p"), unfold.is_recursive(steps, "q"))], "closure boolean, steps boolean")


@query("SELECT DISTINCT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def mapping_composition(t: Tables) -> DataFrame:
    steps = [parse_tgd("home(c, g) :- customer(c, n, k, b, s), nation(k, m, g)"), parse_tgd("ans(c, r) :- home(c, g), region(g, r)")]
    (one,) = [m for m in mappings.composed(steps, {"home"}) if m.heads[0].relation == "ans"]
    return compile_rule(Rule(one.heads[0], one.body), t).toDF("c", "r")


@query("SELECT DISTINCT c_custkey AS c, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rule_inlined_definition(t: Tables) -> DataFrame:
    rule = mappings.inlined(parse_rule("ans(c, g) :- lives(c, k), nation(k, n, g)"), parse_rules(["lives(c, k) :- customer(c, n, k, b, s)"]))
    assert all(a.relation != "lives" for a in rule.positive())
    return compile_rule(rule, t)


# ---------------------------------------------------------------- tables and outer joins


@query("SELECT 'region' AS table_name, count(*) AS n FROM region" + "".join(f" UNION ALL SELECT '{n}', count(*) FROM {n}" for n in NAMES[1:]))
def count_all_tables(t: Tables) -> DataFrame:
    return relational.counts({n: t[n] for n in NAMES})


@query("SELECT 'o' AS name, 0 AS n UNION ALL SELECT 'o_L', count(*) FROM orders UNION ALL SELECT 'copy', count(*) FROM orders UNION ALL SELECT 'moved', count(*) FROM orders UNION ALL SELECT 'differ', 0")
def table_housekeeping(t: Tables) -> DataFrame:
    known = TableSet(t.spark)
    schema = t["orders"].schema
    known.create_with_companions("o", schema)
    for name in ("copy", "moved", "differ"):
        known.create(name, schema)
    known.replace("o", t["orders"])
    known.migrate("o")
    known.copy("o", "copy")
    known.move("o", "moved")
    gone = known.compare("copy", "moved")
    found = relational.counts({n: known[n] for n in ("o", "o_L", "copy", "moved")})
    return found.unionByName(t.spark.createDataFrame([("differ", gone)], "table_name string, n long")).withColumnRenamed("table_name", "name")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON o_custkey = k WHERE o_custkey IS NULL OR k IS NULL")
def table_difference_count(t: Tables) -> DataFrame:
    of = lambda s: t["orders"].where(F.col("o_orderstatus") == s).select("o_custkey")
    return t.spark.createDataFrame([(relational.difference_count(of("F").distinct(), of("O").distinct()),)], "n long")


@query("SELECT s_suppkey AS s, c_custkey AS c FROM supplier RIGHT JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) < 50")
def join_user_predicate_right(t: Tables) -> DataFrame:
    known = PredicateRegistry()
    known.register("near", lambda a, b: F.abs(a - b) < 50)
    s = t["supplier"].select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("b"))
    c = t["customer"].select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b"))
    return known.join(s, c, "near", ["b"], ["b"], "right", equal=["k"]).select(F.col("s_suppkey").alias("s"), F.col("c_custkey").alias("c"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_orderkey FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) ON o_custkey = c_custkey)")
def labeled_join_across_types(t: Tables) -> DataFrame:
    """Columns with companions of labels, of type bigint on one side and double on the other."""
    none = F.lit(None).cast("string")
    t["l"] = t["orders"].select("o_orderkey", F.col("o_custkey").alias("k"), none.alias("k_LN"))
    t["r"] = t["customer"].where("c_nationkey < 12").select(F.col("c_custkey").cast("double").alias("k"), none.alias("k_LN"))
    return compile_rule(parse_rule("ans(o) :- l(o, k), r(k)"), t).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- logs and files, written and read back


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id >= 300 GROUP BY event_type")
def epoch_log_range(t: Tables) -> DataFrame:
    """Three published epochs, of which the last two are fetched."""
    log = EpochLog(t.spark, f"{run_dir(t.spark)}/log-{uuid.uuid4().hex}")
    for low, high in ((0, 300), (300, 600), (600, None)):
        rows = t["events"].where(F.col("event_id") >= low)
        log.publish((rows if high is None else rows.where(F.col("event_id") < high)).select("event_id", "event_type"))
    return log.read(after=1).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def store_dump_restore(t: Tables) -> DataFrame:
    folder = f"{run_dir(t.spark)}/dump-{uuid.uuid4().hex}"
    dump({"customer": t["customer"].select("c_custkey", "c_name", "c_nationkey")}, folder)
    return restore(t.spark, folder, ["customer"])["customer"]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def delimited_round_trip(t: Tables) -> DataFrame:
    r = Relation("p", "s", "nation", (Field("n_nationkey", "int", key=True), Field("n_name", "string"), Field("n_regionkey", "int")))
    folder = f"{run_dir(t.spark)}/files-{uuid.uuid4().hex}"
    delimited.write(t["nation"], folder, r)
    return delimited.read(t.spark, folder, r).select("n_nationkey", "n_name", "n_regionkey")
