"""Queries over the Parquet tables, one or more per operator, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .program import Program
from .storage import scratch_path

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def load(program: Program, sf_dir: str, tables: dict[str, str]) -> Program:
    """Relations from tables, as ``{"edge": "lineitem: l_orderkey, l_partkey as p"}``; ``tag=...`` names the probability."""
    for name, what in tables.items():
        table, _, columns = what.partition(":")
        parts = [c.strip() for c in columns.split(";")]
        tag = next((c[4:] for c in parts if c.startswith("tag=")), None)
        exprs = [c for c in parts if not c.startswith("tag=")]
        df = program.spark.read.parquet(f"{sf_dir}/{table.strip()}.parquet").selectExpr(*exprs, *([f"{tag} as __given"] if tag else []))
        program.add_table(name, df, "__given" if tag else None)
    return program


def query(name: str, tables: dict[str, str], text: str, columns: str, sql: str | None = None, provenance: str = "unit", relation: str = "out", digits: int | None = None, distinct_sql: bool = False, **options: object) -> None:
    """Register a program's relation as a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        program = load(Program(spark, provenance), sf_dir, tables).add(text)
        if options:
            program.run(only=[relation], **options)
        df = program.relation(relation, columns.split())
        if digits is not None:
            for c, kind in df.dtypes:
                if kind in ("double", "float"):
                    df = df.withColumn(c, F.round(c, digits))
        return df

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def python(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function as a query."""

    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


NATION = {"nation": "nation: n_nationkey; n_name; n_regionkey", "region": "region: r_regionkey; r_name"}
CUSTOMER = {"customer": "customer: c_custkey; c_nationkey; c_mktsegment; c_acctbal"}
SUPPLIER = {"supplier": "supplier: s_suppkey; s_nationkey; s_acctbal"}
ORDERS = {"orders": "orders: o_orderkey; o_custkey; o_orderstatus; o_totalprice; o_orderpriority"}
PART = {"part": "part: p_partkey; p_brand; p_type; p_size; p_retailprice"}
#: A node for each supplier; edges go to half of its number, and those at the root make a ring.
HALF = "cast(if(s_suppkey <= 1, 6, s_suppkey div 2) as int)"
EDGES = {"edge": f"supplier: cast(s_suppkey as int); {HALF}"}
EDGES_SQL = "edge AS (SELECT CAST(s_suppkey AS INTEGER) AS a, CAST(CASE WHEN s_suppkey <= 1 THEN 6 ELSE s_suppkey // 2 END AS INTEGER) AS b FROM supplier)"
TREE = {"edge": "nation: n_regionkey; n_nationkey + 5"}
#: An acyclic graph with a weight on each edge.
DAG = {"edge": "nation: n_nationkey; n_nationkey + 1 + n_regionkey % 2; tag=(0.5 + n_regionkey * 0.1D)"}
DAG_SQL = "edge AS (SELECT n_nationkey AS a, n_nationkey + 1 + n_regionkey % 2 AS b, CAST(0.5 + n_regionkey * CAST(0.1 AS DOUBLE) AS DOUBLE) AS p FROM nation)"

# scans, projection, filter

query("scan_project", {"item": "lineitem: l_orderkey; l_linenumber; l_quantity; l_extendedprice; l_discount"}, "rel out(o, n, p * (1.0 - d)) = item(o, n, _, p, d)", "orderkey line net", "SELECT DISTINCT l_orderkey AS orderkey, l_linenumber AS line, l_extendedprice * (1.0 - l_discount) AS net FROM lineitem", digits=None)
query("filter_pred", ORDERS, 'rel out(k, p) = orders(k, _, s, p, _), p > 100000.0 && s == "F" || p < 2000.0', "orderkey price", "SELECT DISTINCT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F' OR o_totalprice < 2000.0")
query("find_const", NATION, "rel out(k, n) = nation(k, n, 3)", "nationkey name", "SELECT n_nationkey AS nationkey, n_name AS name FROM nation WHERE n_regionkey = 3")
query("repeated_var", {"item": "lineitem: l_orderkey; l_partkey; l_suppkey"}, "rel out(o, k) = item(o, k, k)", "orderkey bothkey", "SELECT DISTINCT l_orderkey AS orderkey, l_partkey AS bothkey FROM lineitem WHERE l_partkey = l_suppkey")
query("if_then_else", PART, 'rel out(k, if s > 25 then "large" else "small", s % 2 == 0 ? s / 2 : s * 3) = part(k, _, _, s, _)', "partkey label step", "SELECT p_partkey AS partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS label, CASE WHEN p_size % 2 = 0 THEN p_size // 2 ELSE p_size * 3 END AS step FROM part")
query("constants_enum", PART, "const LIMIT = 10\ntype Kind = SMALL | BIG\nrel out(k, SMALL) = part(k, _, _, s, _), s <= LIMIT\nrel out(k, BIG) = part(k, _, _, s, _), s > LIMIT", "partkey kind", "SELECT p_partkey AS partkey, CAST(CASE WHEN p_size <= 10 THEN 0 ELSE 1 END AS BIGINT) AS kind FROM part")
query("equality_chain", {"item": "part: p_partkey; p_size"}, "rel out(k, y) = item(k, x), y == z + 1, z == x * 2", "partkey y", "SELECT p_partkey AS partkey, p_size * 2 + 1 AS y FROM part")

# joins and set operations

query("equi_join", NATION, "rel out(n, r) = nation(_, n, k), region(k, r)", "nation region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
query("multi_way_join", NATION | CUSTOMER | ORDERS, 'rel out(o, n, r) = orders(o, c, "O", _, _), customer(c, k, "BUILDING", _), nation(k, n, g), region(g, r)', "orderkey nation region", "SELECT DISTINCT o_orderkey AS orderkey, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' AND c_mktsegment = 'BUILDING'")
query("self_join", SUPPLIER, "rel out(a, b) = supplier(a, n, _), supplier(b, n, _), a < b", "one two", "SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
query("product", NATION, "rel out(a, b) = region(_, a), region(_, b)", "one two", "SELECT a.r_name AS one, b.r_name AS two FROM region a, region b")
query("theta_join", NATION, "rel out(a, b) = nation(a, _, x), nation(b, _, y), x < y, a > b", "one two", "SELECT a.n_nationkey AS one, b.n_nationkey AS two FROM nation a, nation b WHERE a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
query("indexed_join", NATION | CUSTOMER, '@storage("indexed_vec")\ntype nation(i32, String, i32)\nrel out(c, n) = customer(c, k, _, _), nation(k, n, _)', "custkey nation", "SELECT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
query("intersect", CUSTOMER | SUPPLIER, "rel cust(n) = customer(_, n, _, _)\nrel supp(n) = supplier(_, n, _)\nrel out(n) = cust(n), supp(n)", "nationkey", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
query("union_dedup", CUSTOMER | SUPPLIER, "rel out(n) = customer(_, n, _, _) or supplier(_, n, _)", "nationkey", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
query("difference", PART, 'rel big(b) = part(_, b, _, s, _), s > 49\nrel every(b) = part(_, b, _, _, _)\nrel out(b) = every(b), not big(b)', "brand", "SELECT p_brand AS brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 49")
query("antijoin", CUSTOMER | ORDERS, 'rel urgent(c) = orders(_, c, _, _, "1-URGENT")\nrel out(c, s) = customer(c, _, s, _), not urgent(c)', "custkey segment", "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
query("antijoin_wildcard", CUSTOMER | ORDERS, 'rel f(c, k) = orders(k, c, "F", _, _)\nrel out(c) = customer(c, _, _, _), not f(c, _)', "custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
query("semi_exists", CUSTOMER | ORDERS, 'rel out(c) = customer(c, _, _, _), exists(o: orders(o, c, "P", p, _), p > 150000.0)', "custkey", "SELECT c_custkey AS custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 150000.0)")
query("not_exists", CUSTOMER | ORDERS, 'rel out(c) = customer(c, _, _, _), not exists(o: orders(o, c, "P", p, _), p > 150000.0)', "custkey", "SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 150000.0)")
query("forall_implies", NATION | SUPPLIER, "rel out(n) = nation(n, _, _), forall(s: supplier(s, n, a) implies a > 0.0)", "nationkey", "SELECT n_nationkey AS nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND NOT s_acctbal > 0)")
query("or_and_nested", PART, 'rel out(k) = part(k, b, _, s, p), (s == 1 or s == 50) and (p < 1000.0 or b == "Brand#13")', "partkey", "SELECT p_partkey AS partkey FROM part WHERE (p_size = 1 OR p_size = 50) AND (p_retailprice < 1000 OR p_brand = 'Brand#13')")
query("implies", PART, 'rel large(k) = part(k, _, _, s, _), s > 40\nrel dear(k) = part(k, _, _, _, p), p > 1200.0\nrel out(k) = part(k, _, _, _, _), (large(k) implies dear(k))', "partkey", "SELECT p_partkey AS partkey FROM part WHERE NOT p_size > 40 OR p_retailprice > 1200")
query("conjunctive_head", NATION, "rel a(k), b(n) = nation(k, n, 2)\nrel out(k, n) = a(k), b(n)", "nationkey name", "SELECT a.n_nationkey AS nationkey, b.n_name AS name FROM nation a, nation b WHERE a.n_regionkey = 2 AND b.n_regionkey = 2")
query("disjunctive_head", NATION, 'rel { out(k, "red"); out(k, "blue") } = region(k, _)', "regionkey colour", "SELECT r_regionkey AS regionkey, colour FROM region, (VALUES ('red'), ('blue')) AS t(colour)")

# aggregates

query("count_all", ORDERS, "rel out(n) = n := count(c: orders(_, c, _, _, _))", "n", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
query("count_group", ORDERS, "rel out(s, n) = n := count(o: orders(o, _, s, _, _))", "status n", "SELECT o_orderstatus AS status, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_orderstatus")
query("count_where_zero", CUSTOMER | ORDERS, 'rel out(c, n) = n := count(o: orders(o, c, "P", p, _), p > 150000.0 where c: customer(c, _, _, _))', "custkey n", "SELECT c_custkey AS custkey, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 150000.0 GROUP BY c_custkey")
query("count_empty", ORDERS, 'rel out(n) = n := count(o: orders(o, _, "X", _, _))', "n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'X'")
query("sum_distinct", PART, "rel out(b, s) = s := sum(z: part(_, b, _, z, _))", "brand total", "SELECT p_brand AS brand, CAST(sum(DISTINCT p_size) AS INTEGER) AS total FROM part GROUP BY p_brand")
query("sum_by_arg", PART, "rel out(b, s) = s := sum[k](z: part(k, b, _, z, _))", "brand total", "SELECT p_brand AS brand, CAST(sum(p_size) AS INTEGER) AS total FROM part GROUP BY p_brand")
query("prod", NATION, "rel out(r, p) = p := prod(x: nation(k, _, r), x == k + 1)", "regionkey product", "SELECT n_regionkey AS regionkey, CAST(product(n_nationkey + 1) AS INTEGER) AS product FROM nation GROUP BY n_regionkey")
query("avg_float", CUSTOMER, "rel out(s, a) = a := avg[c](b: customer(c, _, s, b))", "segment mean", "SELECT c_mktsegment AS segment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment", digits=4)
query("avg_int_trunc", PART, "rel out(b, a) = a := avg[k](s: part(k, b, _, s, _))", "brand mean", "SELECT p_brand AS brand, CAST(sum(p_size) // count(*) AS INTEGER) AS mean FROM part GROUP BY p_brand")
query("min_ties", PART, "rel out(b, k, s) = (k, s) := min[k](s: part(k, b, _, s, _))", "brand partkey size", "SELECT p_brand AS brand, p_partkey AS partkey, p_size AS size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size) = 1")
query("max_tuple", SUPPLIER, "rel out(n, a, s) = (a, s) := max(a, s: supplier(s, n, a))", "nationkey balance suppkey", "SELECT s_nationkey AS nationkey, s_acctbal AS balance, s_suppkey AS suppkey FROM supplier QUALIFY rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) = 1")
query("argmin_all_ties", PART, "rel out(b, k) = k := argmin[k](s: part(k, b, _, s, _))", "brand partkey", "SELECT p_brand AS brand, p_partkey AS partkey FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size) = 1")
query("argmax", CUSTOMER, "rel out(s, c) = c := argmax[c](b: customer(c, _, s, b))", "segment custkey", "SELECT c_mktsegment AS segment, c_custkey AS custkey FROM customer QUALIFY rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) = 1")
query("exists_bool", NATION | SUPPLIER, "rel out(n, b) = b := exists(s: supplier(s, n, a), a > 9000.0 where n: nation(n, _, _))", "nationkey rich", "SELECT n_nationkey AS nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS rich FROM nation")
query("exists_empty", NATION, 'rel out(b) = b := exists(n: nation(_, n, 77))', "found", "SELECT false AS found")
query("string_join", NATION, 'rel out(r, s) = s := string_join<"|">(n: nation(_, n, r))', "regionkey names", "SELECT n_regionkey AS regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
query("string_join_arg", NATION, 'rel out(r, s) = s := string_join<",">[d](n: nation(k, n, r), d == 0 - k)', "regionkey names", "SELECT n_regionkey AS regionkey, string_agg(n_name, ',' ORDER BY -n_nationkey) AS names FROM nation GROUP BY n_regionkey")
query("enumerate", NATION, "rel out(r, i, n) = (i, n) := enumerate(n: nation(_, n, r))", "regionkey place name", "SELECT n_regionkey AS regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS place, n_name AS name FROM nation")
query("sort_desc_default", SUPPLIER, "rel out(n, i, s, a) = (i, s, a) := sort[s](a: supplier(s, n, a))", "nationkey place suppkey balance", "SELECT s_nationkey AS nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS place, s_suppkey AS suppkey, s_acctbal AS balance FROM supplier")
query("argsort_asc", SUPPLIER, "rel out(n, i, s) = (i, s) := argsort<asc>[s](a: supplier(s, n, a))", "nationkey place suppkey", "SELECT s_nationkey AS nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS place, s_suppkey AS suppkey FROM supplier")
WEIGHTED = {"item": "supplier: s_suppkey; s_nationkey; tag=((s_suppkey * 37 % 101) / 101D)"}
WEIGHT = "CAST((s_suppkey * 37 % 101) / CAST(101 AS DOUBLE) AS DOUBLE)"
query("rank_weight", WEIGHTED, "rel out(n, i, s) = (i, s) := rank(s: item(s, n))", "nationkey place suppkey", f"SELECT s_nationkey AS nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY {WEIGHT} DESC, s_suppkey) - 1 AS place, s_suppkey AS suppkey, round({WEIGHT}, 6) AS tag FROM supplier", "minmaxprob", digits=6)
query("top_k_weight", WEIGHTED, "rel out(n, s) = s := top<2>(s: item(s, n))", "nationkey suppkey", f"SELECT s_nationkey AS nationkey, s_suppkey AS suppkey, round({WEIGHT}, 6) AS tag FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY {WEIGHT} DESC, s_suppkey) <= 2", "minmaxprob", digits=6)
query("unique", WEIGHTED, "rel out(n, s) = s := unique(s: item(s, n))", "nationkey suppkey", f"SELECT s_nationkey AS nationkey, s_suppkey AS suppkey, round({WEIGHT}, 6) AS tag FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY {WEIGHT} DESC, s_suppkey) <= 1", "minmaxprob", digits=6)
query("normalize", WEIGHTED, "rel out(n, s) = s := normalize(s: item(s, n))", "nationkey suppkey", f"SELECT s_nationkey AS nationkey, s_suppkey AS suppkey, round(CASE WHEN sum({WEIGHT}) OVER (PARTITION BY s_nationkey) = 0 THEN 0.0 ELSE {WEIGHT} / sum({WEIGHT}) OVER (PARTITION BY s_nationkey) END, 6) AS tag FROM supplier", "minmaxprob", digits=6)
query("softmax", WEIGHTED, "rel out(n, s) = s := softmax(s: item(s, n))", "nationkey suppkey", f"SELECT s_nationkey AS nationkey, s_suppkey AS suppkey, round(exp({WEIGHT}) / sum(exp({WEIGHT})) OVER (PARTITION BY s_nationkey), 6) AS tag FROM supplier", "minmaxprob", digits=6)
query("weighted_avg", {"item": "supplier: s_suppkey; s_nationkey; s_acctbal; tag=((1 + s_suppkey * 37 % 101) / 102D)"}, "rel out(n, a) = a := weighted_avg![s](b: item(s, n, b))", "nationkey mean", "SELECT s_nationkey AS nationkey, round(sum((1 + s_suppkey * 37 % 101) / CAST(102 AS DOUBLE) * s_acctbal) / sum((1 + s_suppkey * 37 % 101) / CAST(102 AS DOUBLE)), 4) AS mean, CAST(1.0 AS DOUBLE) AS tag FROM supplier GROUP BY s_nationkey", "minmaxprob", digits=4)
query("weighted_sum", {"item": "supplier: s_suppkey; s_nationkey; s_acctbal; tag=((1 + s_suppkey * 37 % 101) / 102D)"}, "rel out(n, a) = a := weighted_sum![s](b: item(s, n, b))", "nationkey total", "SELECT s_nationkey AS nationkey, round(sum((1 + s_suppkey * 37 % 101) / CAST(102 AS DOUBLE) * s_acctbal), 3) AS total, CAST(1.0 AS DOUBLE) AS tag FROM supplier GROUP BY s_nationkey", "minmaxprob", digits=3)
query("reduce_rule", PART, "rel largest = max(s: part(_, _, _, s, _))\nrel out(s) = largest(s)", "size", "SELECT max(p_size) AS size FROM part")
query("count_hard", WEIGHTED, "rel out(n, c) = c := count!(s: item(s, n))", "nationkey n", "SELECT s_nationkey AS nationkey, count(*) AS n, CAST(1.0 AS DOUBLE) AS tag FROM supplier GROUP BY s_nationkey", "minmaxprob")
query("uniform_k", {"event": "events: event_id; event_type"}, "rel out(t, e) = e := uniform<3>(e: event(e, t))", "type event_id")
query("categorical_k", {"event": "events: event_id; event_type; tag=(event_id % 10 / 10D)"}, "rel out(t, e) = e := categorical<3>(e: event(e, t))", "type event_id", None, "minmaxprob")

# recursion

CLOSURE = f"WITH RECURSIVE {EDGES_SQL}, path AS (SELECT a, b FROM edge UNION SELECT p.a, e.b FROM path p JOIN edge e ON p.b = e.a) SELECT a AS one, b AS two FROM path"
query("closure_left", TREE | {"edge2": "nation: n_nationkey + 5; n_nationkey % 4 + 40"}, "rel e(x, y) = edge(x, y) or edge2(x, y)\nrel out(x, y) = e(x, y) or (out(x, z) and e(z, y))", "one two", "WITH RECURSIVE e AS (SELECT n_regionkey AS a, n_nationkey + 5 AS b FROM nation UNION SELECT n_nationkey + 5, n_nationkey % 4 + 40 FROM nation), path AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM path p JOIN e ON p.b = e.a) SELECT a AS one, b AS two FROM path")
query("closure_right", EDGES, "rel out(x, y) = edge(x, y) or (edge(x, z) and out(z, y))", "one two", CLOSURE)
query("closure_cyclic", EDGES, "rel out(x, y) = edge(x, y)\nrel out(x, y) = out(x, z), out(z, y)", "one two", CLOSURE)
query("mutual_recursion", NATION, "rel even(0)\nrel even(y) = odd(x), y == x + 1, y < 12\nrel odd(y) = even(x), y == x + 1, y < 12\nrel out(k, n) = even(k), nation(k, n, _)", "nationkey name", "SELECT n_nationkey AS nationkey, n_name AS name FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 12")
query("fib_demand", {}, 'rel fib = {(0, 1), (1, 1)}\n@demand("bf")\nrel fib(x, a + b) = fib(x - 1, a), fib(x - 2, b), x > 1\nrel out(y) = fib(8, y)', "value", "SELECT 34 AS value")
query("path_demand", EDGES, '@demand("bf")\nrel path(x, y) = edge(x, y) or (path(x, z) and edge(z, y))\nrel out(y) = path(3, y)', "reached", f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT b FROM edge WHERE a = 3 UNION SELECT e.b FROM r JOIN edge e ON r.b = e.a) SELECT b AS reached FROM r")
query("goal_stop", EDGES, "rel reach(y) = edge(1, y) or (reach(x) and edge(x, y))\n@goal\nrel goal(y) = reach(y), y < 40\nrel out(b) = b := exists(y: goal(y))", "reached", "SELECT true AS reached")
query("iter_limit", EDGES, "rel out(x, y) = edge(x, y) or (out(x, z) and edge(z, y))", "one two", f"WITH {EDGES_SQL} SELECT a AS one, b AS two FROM edge UNION SELECT x.a, y.b FROM edge x JOIN edge y ON x.b = y.a", limit=1)
query("scheduler_dfs", TREE, "rel reach(0)\nrel reach(y) = reach(x), edge(x, y)\nrel out(x) = reach(x)", "node", "SELECT 0 AS node UNION SELECT n_nationkey + 5 FROM nation WHERE n_regionkey = 0", scheduler="dfs")
query("stratified_negation", EDGES, "rel reach(y) = edge(1, y) or (reach(x) and edge(x, y))\nrel node(x) = edge(x, _) or edge(_, x)\nrel out(x) = node(x), not reach(x)", "node", f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT b FROM edge WHERE a = 1 UNION SELECT e.b FROM r JOIN edge e ON r.b = e.a) SELECT a AS node FROM (SELECT a FROM edge UNION SELECT b FROM edge) EXCEPT SELECT b FROM r")
query("recursion_count", EDGES, "rel path(x, y) = edge(x, y) or (path(x, z) and edge(z, y))\nrel out(x, n) = n := count(y: path(x, y))", "node reached", f"WITH RECURSIVE {EDGES_SQL}, path AS (SELECT a, b FROM edge UNION SELECT p.a, e.b FROM path p JOIN edge e ON p.b = e.a) SELECT a AS node, count(*) AS reached FROM path GROUP BY a")

# tags

query("boolean_reach", {"edge": "nation: n_nationkey; n_nationkey + 1; tag=cast(n_regionkey < 4 as int)"}, "rel out(y) = edge(0, y) or (out(x) and edge(x, y))", "node", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_regionkey < 4), r AS (SELECT b FROM e WHERE a = 0 UNION SELECT e.b FROM r JOIN e ON r.b = e.a) SELECT b AS node, true AS tag FROM r", "boolean")
query("shortest_hops_tropical", {"edge": f"supplier: cast(s_suppkey as int); {HALF}; tag=1"}, "rel out(x, y) = edge(x, y) or (out(x, z) and edge(z, y))", "one two", f"WITH RECURSIVE {EDGES_SQL}, path AS (SELECT a, b, 1 AS n FROM edge UNION SELECT p.a, e.b, n + 1 FROM path p JOIN edge e ON p.b = e.a WHERE n < 40) SELECT a AS one, b AS two, CAST(min(n) AS BIGINT) AS tag FROM path GROUP BY a, b", "tropical")
query("count_paths_natural", {"edge": "nation: n_nationkey % 5; n_nationkey % 7 + 10; tag=1"}, "rel hop(y, z) = edge(x, y), edge(w, y), z == x + w\nrel out(y) = hop(y, _)", "node", "WITH e AS (SELECT DISTINCT n_nationkey % 5 AS a, n_nationkey % 7 + 10 AS b, 1 AS w FROM nation), c AS (SELECT n_nationkey % 5 AS a, n_nationkey % 7 + 10 AS b, count(*) AS w FROM nation GROUP BY ALL) SELECT x.b AS node, CAST(sum(x.w * y.w) AS BIGINT) AS tag FROM c x JOIN c y ON x.b = y.b GROUP BY x.b", "natural")
query("widest_path_minmax", DAG, "rel out(x, y) = edge(x, y) or (out(x, z) and edge(z, y))", "one two", f"WITH RECURSIVE {DAG_SQL}, path AS (SELECT a, b, p FROM edge UNION SELECT q.a, e.b, least(q.p, e.p) FROM path q JOIN edge e ON q.b = e.a) SELECT a AS one, b AS two, round(max(p), 6) AS tag FROM path GROUP BY a, b", "minmaxprob", digits=6)
query("most_probable_path", DAG, "rel out(x, y) = edge(x, y) or (out(x, z) and edge(z, y))", "one two", f"WITH RECURSIVE {DAG_SQL}, path AS (SELECT a, b, p FROM edge UNION ALL SELECT q.a, e.b, q.p * e.p FROM path q JOIN edge e ON q.b = e.a) SELECT a AS one, b AS two, round(max(p), 6) AS tag FROM path GROUP BY a, b", "maxmultprob", digits=6)
query("noisy_add_mult", {"edge": "nation: n_nationkey % 5; n_nationkey % 7 + 10; tag=0.05D"}, "rel out(x, z) = edge(x, y), edge(w, y), z == w", "one two", "WITH e AS (SELECT n_nationkey % 5 AS a, n_nationkey % 7 + 10 AS b, least(sum(CAST(0.05 AS DOUBLE)), 1.0) AS p FROM nation GROUP BY ALL) SELECT x.a AS one, y.a AS two, round(least(sum(x.p * y.p), 1.0), 6) AS tag FROM e x JOIN e y ON x.b = y.b GROUP BY ALL", "addmultprob", digits=6)
query("negation_prob", {"item": "supplier: s_nationkey; tag=0.9D", "bad": "nation: n_nationkey; tag=(n_regionkey / 10D)"}, "rel out(n) = item(n), not bad(n)", "nationkey", "SELECT DISTINCT s_nationkey AS nationkey, round(least(CAST(0.9 AS DOUBLE), 1 - n_regionkey / CAST(10 AS DOUBLE)), 6) AS tag FROM supplier JOIN nation ON s_nationkey = n_nationkey", "minmaxprob", digits=6)
query("nand_mult", {"item": "supplier: s_nationkey; s_suppkey; tag=0.1D"}, "rel out(n) = item(n, _)", "nationkey", "SELECT s_nationkey AS nationkey, round(1 - pow(0.9, count(*)), 6) AS tag FROM supplier GROUP BY s_nationkey", "nandmultprob", digits=6)
query("tagged_rule", {"item": "part: p_partkey; p_size"}, "rel 1.0 / (n as f64)::out(k) = item(k, n)", "partkey", "SELECT p_partkey AS partkey, round(1.0 / CAST(p_size AS DOUBLE), 6) AS tag FROM part", "minmaxprob", digits=6)
query("soft_count", {"item": "nation: n_regionkey; n_nationkey; tag=0.5D"}, "rel out(r, c) = c := count(n: item(r, n))", "regionkey n", "WITH g AS (SELECT n_regionkey AS r, count(*) AS m FROM nation GROUP BY n_regionkey) SELECT r AS regionkey, k AS n, round(CAST(factorial(CAST(m AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(k AS INTEGER)) * factorial(CAST(m - k AS INTEGER)) AS DOUBLE) * pow(0.5, m), 6) AS tag FROM (SELECT r, m, unnest(range(0, m + 1)) AS k FROM g)", "addmultprob", digits=6)
query("soft_exists", {"item": "nation: n_regionkey; n_nationkey; tag=(n_nationkey / 100D)"}, "rel out(r, b) = b := exists(n: item(r, n))", "regionkey found", "SELECT n_regionkey AS regionkey, found, round(CASE WHEN found THEN max(n_nationkey / CAST(100 AS DOUBLE)) ELSE 1 - max(n_nationkey / CAST(100 AS DOUBLE)) END, 6) AS tag FROM nation, (VALUES (true), (false)) AS t(found) GROUP BY n_regionkey, found", "minmaxprob", digits=6)
query("soft_compare", {"item": "nation: n_nationkey; cast(n_regionkey as double)"}, "rel out(a, b) = item(a, x), item(b, y), soft_gt(x, y)", "one two", "SELECT a.n_nationkey AS one, b.n_nationkey AS two, round(1 / (1 + exp(-(CAST(a.n_regionkey AS DOUBLE) - b.n_regionkey))), 6) AS tag FROM nation a, nation b", "addmultprob", digits=6)
query("topk_proofs_wmc", {"edge": "nation: n_regionkey; n_nationkey % 3 + 10; tag=0.5D", "last": "region: r_regionkey + 10; tag=0.5D"}, "rel out(x) = edge(x, y), last(y)", "node", None, "topkproofs", digits=6)
query("proofs_sets", {"edge": "region: r_regionkey; r_regionkey + 1"}, "rel out(x, y) = edge(x, y) or (out(x, z) and edge(z, y))", "one two", None, "proofs")
query("diff_prob", {"edge": "region: r_regionkey; r_regionkey + 1; tag=0.5D"}, "rel out(x, z) = edge(x, y), edge(y, z)", "one two", None, "difftopkproofs")
query("dual_numbers", {"edge": "region: r_regionkey; r_regionkey + 1; tag=0.5D"}, "rel out(x, z) = edge(x, y), edge(y, z)", "one two", None, "diffaddmultprob")

# tags beside these: schedulers, exclusive and outside tags, negation of proofs, derivatives, soft comparisons and aggregates

REACHED = "WITH RECURSIVE {}, path AS (SELECT b, p FROM edge WHERE a = 0 UNION ALL SELECT e.b, least(q.p, e.p) FROM path q JOIN edge e ON q.b = e.a) SELECT b AS node, round(max(p), 6) AS tag FROM path GROUP BY b".format(DAG_SQL)
query("scheduler_a_star", DAG, "rel out(y) = edge(0, y) or (out(x) and edge(x, y))", "node", REACHED, "minmaxprob", digits=6, scheduler="a-star")
query("scheduler_beam", DAG, "rel out(y) = edge(0, y) or (out(x) and edge(x, y))", "node", REACHED, "minmaxprob", digits=6, scheduler="beam", beam=4)
query("real_tropical", {"edge": "nation: n_nationkey % 5; n_nationkey % 7 + 10; tag=((n_nationkey + 1) / 30D)"}, "rel out(x) = edge(x, _)", "node", "SELECT n_nationkey % 5 AS node, round(min(-ln((n_nationkey + 1) / CAST(30 AS DOUBLE))), 6) AS tag FROM nation GROUP BY n_nationkey % 5", "realtropical", digits=6)
query("exclusive_facts", NATION, "rel lamp = {0.3::1; 0.6::2}\nrel out(r) = region(r, _), lamp(_)", "regionkey", "SELECT r_regionkey AS regionkey, CAST(0.9 AS DOUBLE) AS tag FROM region", "topkproofs", digits=6)
query("disjunct", {"item": "supplier: s_nationkey; s_suppkey; tag=0.0001D"}, "rel one(n, s) = s := disjunct(s: item(n, s))\nrel out(n) = one(n, _)", "nationkey", "SELECT s_nationkey AS nationkey, round(CAST(0.0001 AS DOUBLE) * count(*), 6) AS tag FROM supplier GROUP BY s_nationkey", "probproofs", digits=6)
query("proofs_negated", {"item": "nation: n_regionkey; n_nationkey; tag=((n_nationkey + 1) / 50D)"} | NATION, "rel some(r) = item(r, _)\nrel out(r) = region(r, _), not some(r)", "regionkey", "SELECT n_regionkey AS regionkey, round(product(1 - p), 6) AS tag FROM (SELECT n_regionkey, (n_nationkey + 1) / CAST(50 AS DOUBLE) AS p FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY p DESC) <= 3) GROUP BY n_regionkey", "topbottomkclauses", digits=6)


@python("rule_tags", "SELECT r_regionkey AS regionkey, round(CAST(0.2 AS DOUBLE) * r_regionkey / 10, 6) AS tag FROM region")
def rule_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule whose probability comes from outside."""
    p = load(Program(spark, "maxmultprob"), sf_dir, {"region": "region: r_regionkey; tag=(r_regionkey / 10D)"})
    return p.add("@tagged\nrel out(r) = region(r)").tag_rule("out", 0.2).relation("out", ["regionkey"]).withColumn("tag", F.round("tag", 6))


@python("dual_number_parts", "SELECT n_regionkey AS regionkey, round(1 - product(1 - (n_nationkey + 1) / CAST(100 AS DOUBLE)), 6) AS p, count(*) AS facts, round(sum(g), 6) AS slope FROM (SELECT *, product(1 - (n_nationkey + 1) / CAST(100 AS DOUBLE)) OVER (PARTITION BY n_regionkey) / (1 - (n_nationkey + 1) / CAST(100 AS DOUBLE)) AS g FROM nation) GROUP BY n_regionkey")
def dual_number_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of alternatives with their derivatives by each fact."""
    p = load(Program(spark, "diffnandmultprob"), sf_dir, {"item": "nation: n_regionkey; n_nationkey; tag=((n_nationkey + 1) / 100D)"}).add("rel out(r) = item(r, _)")
    slopes = F.map_values("tag.gradient")
    return p.relation("out", ["regionkey"]).select("regionkey", F.round("tag.p", 6).alias("p"), F.size(slopes).cast("bigint").alias("facts"), F.round(F.aggregate(slopes, F.lit(0.0), lambda a, x: a + x), 6).alias("slope"))


@python("soft_sigmoids", "SELECT a.n_nationkey AS one, b.n_nationkey AS two, round(atan(2.0 * (a.n_regionkey - b.n_regionkey)) / pi() + 0.5, 6) AS tag FROM nation a, nation b")
def soft_sigmoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(Program(spark, "addmultprob"), sf_dir, {"item": "nation: n_nationkey; cast(n_regionkey as double)"}).soft_comparison("cauchy", beta=2.0)
    return p.add("rel out(a, b) = item(a, x), item(b, y), soft_gt(x, y)").relation("out", ["one", "two"]).withColumn("tag", F.round("tag", 6))


REGIONS = {"item": "nation: n_nationkey; cast(n_regionkey as double)"}
query("soft_eq", REGIONS, "rel out(a, b) = item(a, x), item(b, y), soft_eq(x, y)", "one two", "SELECT a.n_nationkey AS one, b.n_nationkey AS two, round(1 / cosh((a.n_regionkey - b.n_regionkey) / CAST(2 AS DOUBLE)), 6) AS tag FROM nation a, nation b", "addmultprob", digits=6)
query("soft_neq", REGIONS, "rel out(a, b) = item(a, x), item(b, y), soft_neq(x, y)", "one two", "SELECT a.n_nationkey AS one, b.n_nationkey AS two, round(1 - 1 / cosh((a.n_regionkey - b.n_regionkey) / CAST(2 AS DOUBLE)), 6) AS tag FROM nation a, nation b", "addmultprob", digits=6)
query("soft_lt", REGIONS, "rel out(a, b) = item(a, x), item(b, y), soft_lt(x, y)", "one two", "SELECT a.n_nationkey AS one, b.n_nationkey AS two, round(1 / (1 + exp(CAST(a.n_regionkey AS DOUBLE) - b.n_regionkey)), 6) AS tag FROM nation a, nation b", "addmultprob", digits=6)
query("new_tag_variable", NATION, "rel out(r) = region(r, _), new_tag_variable()", "regionkey", "SELECT r_regionkey AS regionkey, CAST(1.0 AS DOUBLE) AS tag FROM region", "topkproofs", digits=6)
CHANCE = "CAST((s_suppkey * 37 % 101) / CAST(202 AS DOUBLE) AS DOUBLE)"
CHANCES = {"item": "supplier: s_nationkey; s_suppkey; cast(s_suppkey % 5 as int); tag=((s_suppkey * 37 % 101) / 202D)"}
query("soft_exists_product", CHANCES, "rel out(n, b) = b := exists(s: item(n, s, _))", "nationkey found", f"WITH g AS (SELECT s_nationkey AS n, product(1 - {CHANCE}) AS q FROM supplier GROUP BY s_nationkey) SELECT n AS nationkey, true AS found, round(1 - q, 6) AS tag FROM g UNION ALL SELECT n, false, round(q, 6) FROM g", "nandmultprob", digits=6)
query("soft_min", CHANCES, "rel out(n, v) = v := min(v: item(n, _, v))", "nationkey least", f"WITH g AS (SELECT s_nationkey AS n, CAST(s_suppkey % 5 AS INTEGER) AS v, max({CHANCE}) AS p FROM supplier GROUP BY ALL) SELECT n AS nationkey, v AS least, round(p * coalesce(product(1 - p) OVER (PARTITION BY n ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0), 6) AS tag FROM g", "maxmultprob", digits=6)
query("soft_argmax", CHANCES, "rel out(n, s) = s := argmax[s](v: item(n, s, v))", "nationkey suppkey", f"WITH g AS (SELECT s_nationkey AS n, s_suppkey % 5 AS v, min(1 - {CHANCE}) AS q FROM supplier GROUP BY ALL), h AS (SELECT n, v, coalesce(min(q) OVER (PARTITION BY n ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS before FROM g) SELECT s_nationkey AS nationkey, s_suppkey AS suppkey, round(least(before, {CHANCE}), 6) AS tag FROM supplier JOIN h ON n = s_nationkey AND v = s_suppkey % 5", "minmaxprob", digits=6)
query("soft_count_minmax", CHANCES, "rel out(n, c) = c := count(s: item(n, s, _))", "nationkey n", f"WITH g AS (SELECT s_nationkey AS n, {CHANCE} AS p, row_number() OVER (PARTITION BY s_nationkey ORDER BY {CHANCE} DESC) AS k, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier), c AS (SELECT n, m, unnest(range(0, m + 1)) AS k FROM (SELECT DISTINCT n, m FROM g)) SELECT c.n AS nationkey, c.k AS n, round(least(coalesce(a.p, 1.0), 1 - coalesce(b.p, 0.0)), 6) AS tag FROM c LEFT JOIN g a ON a.n = c.n AND a.k = c.k LEFT JOIN g b ON b.n = c.n AND b.k = c.k + 1", "minmaxprob", digits=6)
query("soft_sum", {"item": "nation: n_regionkey; n_nationkey; cast(2 as int); tag=0.5D"}, "rel out(r, t) = t := sum[n](v: item(r, n, v))", "regionkey total", "WITH g AS (SELECT n_regionkey AS r, count(*) AS m FROM nation GROUP BY n_regionkey) SELECT r AS regionkey, CAST(2 * k AS INTEGER) AS total, round(CAST(factorial(CAST(m AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(k AS INTEGER)) * factorial(CAST(m - k AS INTEGER)) AS DOUBLE) * pow(0.5, m), 6) AS tag FROM (SELECT r, m, unnest(range(0, m + 1)) AS k FROM g)", "addmultprob", digits=6)
query("soft_prod", {"item": "nation: n_regionkey; n_nationkey; cast(3 as int); tag=0.5D"}, "rel out(r, t) = t := prod[n](v: item(r, n, v))", "regionkey product", "WITH g AS (SELECT n_regionkey AS r, count(*) AS m FROM nation GROUP BY n_regionkey) SELECT r AS regionkey, CAST(pow(3, k) AS INTEGER) AS product, round(CAST(factorial(CAST(m AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(k AS INTEGER)) * factorial(CAST(m - k AS INTEGER)) AS DOUBLE) * pow(0.5, m), 6) AS tag FROM (SELECT r, m, unnest(range(0, m + 1)) AS k FROM g)", "addmultprob", digits=6)
query("soft_avg", {"item": "nation: n_regionkey; n_nationkey; 6.0D; tag=0.5D"}, "rel out(r, t) = t := avg[n](v: item(r, n, v))", "regionkey mean", "SELECT n_regionkey AS regionkey, CAST(6.0 AS DOUBLE) AS mean, CAST(0.5 AS DOUBLE) AS tag FROM nation GROUP BY n_regionkey", "minmaxprob", digits=6)

# functions

DOC = {"doc": "documents: doc_id; text"}
query("str_length", DOC, "rel out(k, $string_length(t)) = doc(k, t)", "doc_id bytes", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
query("str_case", DOC, "rel out(k, $string_upper(t), $string_lower(t)) = doc(k, t)", "doc_id up low", f"SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents")
query("str_concat_format", NATION, 'rel out($string_concat(n, "-", r), $format("{}: {} ({})", k, n, r)) = nation(k, n, g), region(g, r)', "joined shown", "SELECT n_name || '-' || r_name AS joined, n_nationkey || ': ' || n_name || ' (' || r_name || ')' AS shown FROM nation JOIN region ON n_regionkey = r_regionkey")
query("str_plus", NATION, 'rel out(n + "/" + r) = nation(_, n, g), region(g, r)', "joined", "SELECT n_name || '/' || r_name AS joined FROM nation JOIN region ON n_regionkey = r_regionkey")
query("str_substring", NATION, "rel out(n, $substring(n, 1, 3), $substring(n, 2)) = nation(_, n, _)", "name middle rest", "SELECT n_name AS name, substring(n_name, 2, 2) AS middle, substring(n_name, 3) AS rest FROM nation")
query("str_index_of", NATION, 'rel out(n, $string_index_of(n, "1")) = nation(_, n, _)', "name place", "SELECT n_name AS name, CAST(strpos(n_name, '1') - 1 AS BIGINT) AS place FROM nation WHERE strpos(n_name, '1') > 0")
query("str_char_at", DOC, "rel out(k, $string_char_at(t, 5)) = doc(k, t)", "doc_id letter", f"SELECT doc_id, substring(text, 6, 1) AS letter FROM documents WHERE length(text) > 5")
query("str_replace_trim", DOC, 'rel out(k, $string_replace(t, "th", "TH"), $string_trim("  x ")) = doc(k, t)', "doc_id changed trimmed", f"SELECT doc_id, replace(text, 'th', 'TH') AS changed, 'x' AS trimmed FROM documents")
query("math_round_abs", CUSTOMER, "rel out(c, $abs(b), $floor(b), $ceil(b), $sign(b)) = customer(c, _, _, b)", "custkey size low high sign", "SELECT c_custkey AS custkey, abs(c_acctbal) AS size, CAST(floor(c_acctbal) AS DOUBLE) AS low, CAST(ceil(c_acctbal) AS DOUBLE) AS high, CAST(sign(c_acctbal) AS INTEGER) AS sign FROM customer")
query("math_log_partial", CUSTOMER, "rel out(c, $log(b), $log2(b)) = customer(c, _, _, b)", "custkey ln lb", "SELECT c_custkey AS custkey, round(ln(c_acctbal), 9) AS ln, round(log2(c_acctbal), 9) AS lb FROM customer WHERE c_acctbal > 0", digits=9)
query("math_exp_trig", {"item": "part: p_partkey; cast(p_size as double)"}, "rel out(k, $exp(0.0 - x), $exp2(x / 10.0), $sin(x), $cos(x), $tan(x), $atan(x), $atan2(x, 2.0)) = item(k, x)", "partkey e e2 s c t a a2", "SELECT p_partkey AS partkey, round(exp(-p_size::DOUBLE), 9) AS e, round(pow(2.0, p_size::DOUBLE / 10.0), 9) AS e2, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 9) AS t, round(atan(p_size), 9) AS a, round(atan2(p_size, 2.0), 9) AS a2 FROM part", digits=9)
query("math_asin_partial", {"item": "part: p_partkey; cast(p_size / 25D as double)"}, "rel out(k, $asin(x), $acos(x)) = item(k, x)", "partkey s c", "SELECT p_partkey AS partkey, round(asin(p_size / CAST(25 AS DOUBLE)), 9) AS s, round(acos(p_size / CAST(25 AS DOUBLE)), 9) AS c FROM part WHERE p_size <= 25", digits=9)
query("math_pow_minmax", PART, "rel out(k, $pow(s, 3), $max(s, 20), $min(s, 20, 10), $powf(p, 0.5)) = part(k, _, _, s, p)", "partkey cube most least root", "SELECT p_partkey AS partkey, CAST(p_size * p_size * p_size AS INTEGER) AS cube, greatest(p_size, 20) AS most, least(p_size, 10) AS least, round(sqrt(p_retailprice), 6) AS root FROM part", digits=6)
query("date_parts", {"o": "orders: o_orderkey; o_orderdate"}, "rel out(k, $datetime_year(d), $datetime_month(d), $datetime_month0(d), $datetime_day(d)) = o(k, d)", "orderkey y m m0 d", "SELECT o_orderkey AS orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, month(o_orderdate) AS m, month(o_orderdate) - 1 AS m0, day(o_orderdate) AS d FROM orders")
query("date_arith", {"o": "orders: o_orderkey; o_orderdate"}, 'rel out(k, d + d"1 month", d - d"3d2h") = o(k, d), d > t"1995-06-01"', "orderkey later sooner", "SELECT o_orderkey AS orderkey, o_orderdate + INTERVAL 1 MONTH AS later, o_orderdate - INTERVAL 74 HOUR AS sooner FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01'")
query("cast_drop", {"d": "documents: doc_id; source"}, 'rel out(k, n) = d(k, s), n == $string_replace(s, "src1", "1") as i32', "doc_id number", "SELECT doc_id, TRY_CAST(replace(source, 'src1', '1') AS INTEGER) AS number FROM documents WHERE TRY_CAST(replace(source, 'src1', '1') AS INTEGER) IS NOT NULL")
query("cast_wrap", PART, "rel out(k, (s * 100) as i8, s as f64, s as String) = part(k, _, _, s, _)", "partkey wrapped real shown", "SELECT p_partkey AS partkey, CAST(((p_size * 100 + 128) % 256) - 128 AS TINYINT) AS wrapped, CAST(p_size AS DOUBLE) AS real, CAST(p_size AS VARCHAR) AS shown FROM part")
query("div_nan_drop", {"item": "part: p_partkey; cast(p_size % 3 as double); cast(p_size % 2 as double)"}, "rel out(k, a / b) = item(k, a, b)", "partkey ratio", "SELECT p_partkey AS partkey, CASE WHEN p_size % 2 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(p_size % 3 AS DOUBLE) END AS ratio FROM part WHERE NOT (p_size % 2 = 0 AND p_size % 3 = 0)")
query("saturating_add", {"item": "part: p_partkey; p_size"}, "rel out(k, s + 2147483600, 0 - 2147483647 - s, s - 3, s / 4, s % 4) = item(k, s)", "partkey high low less part rest", "SELECT p_partkey AS partkey, CAST(least(CAST(p_size AS BIGINT) + 2147483600, 2147483647) AS INTEGER) AS high, CAST(greatest(-2147483647 - CAST(p_size AS BIGINT), -2147483648) AS INTEGER) AS low, p_size - 3 AS less, p_size // 4 AS part, p_size % 4 AS rest FROM part")
query("logic_ops", PART, "rel out(k, s > 10 && p > 1000.0, s > 10 || p > 1000.0, (s > 10) ^ (p > 1000.0), !(s > 10)) = part(k, _, _, s, p)", "partkey both either one neither", "SELECT p_partkey AS partkey, p_size > 10 AND p_retailprice > 1000 AS both, p_size > 10 OR p_retailprice > 1000 AS either, (p_size > 10) <> (p_retailprice > 1000) AS one, NOT p_size > 10 AS neither FROM part")
query("hash_function", NATION, "rel h(k, $hash(r, 7)) = nation(k, _, r)\nrel out(a, b) = h(a, x), h(b, x), a < b", "one two", "SELECT a.n_nationkey AS one, b.n_nationkey AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")

# table functions

query("range_tvf", NATION, "rel out(k, i) = nation(k, _, r), range(r, r + 3, i)", "nationkey i", "SELECT n_nationkey AS nationkey, unnest(range(n_regionkey, n_regionkey + 3))::INTEGER AS i FROM nation")
query("range_in", NATION, "rel out(k, i) = nation(k, _, r), i in 2..=r", "nationkey i", "SELECT n_nationkey AS nationkey, CAST(unnest(range(2, n_regionkey + 1)) AS INTEGER) AS i FROM nation")
query("string_chars_tvf", NATION, "rel out(n, i, c) = nation(_, n, _), string_chars(n, i, c)", "name place letter", "SELECT n_name AS name, i - 1 AS place, substring(n_name, CAST(i AS INTEGER), 1) AS letter FROM (SELECT n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation)")
query("string_split_tvf", DOC, 'rel out(k, w) = doc(k, t), string_split(t, " ", w)', "doc_id word", f"SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
query("string_find_tvf", NATION, 'rel out(n, b, e) = nation(_, n, _), string_find(n, "N", b, e)', "name first last", "SELECT n_name AS name, i - 1 AS first, i AS last FROM (SELECT n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation) WHERE substring(n_name, CAST(i AS INTEGER), 1) = 'N'")
query("string_index_tvf", NATION, "rel out(n, i) = nation(_, n, _), string_index(n, i)", "name place", "SELECT n_name AS name, unnest(range(0, strlen(n_name))) AS place FROM nation")
query("datetime_ymd_tvf", {"o": "orders: o_orderkey; o_orderdate"}, "rel out(k, y, m) = o(k, d), datetime_ymd(d, y, m, 1)", "orderkey y m", "SELECT o_orderkey AS orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, month(o_orderdate) AS m FROM orders WHERE day(o_orderdate) = 1")
query("float_eq", {"a": "part: p_partkey; p_retailprice"}, "rel out(k) = a(k, p), float_eq(p, 1000.0)", "partkey", "SELECT p_partkey AS partkey FROM part WHERE abs(p_retailprice - 1000) < 0.001")

# terms

query("adt_eval", NATION, "type Expr = Leaf(i32) | Plus(Expr, Expr) | Times(Expr, Expr)\nconst ROOT = Plus(Leaf(5), Times(Leaf(3), Leaf(6)))\nrel value(e, n) = case e is Leaf(n)\nrel value(e, a + b) = case e is Plus(x, y) and value(x, a) and value(y, b)\nrel value(e, a * b) = case e is Times(x, y) and value(x, a) and value(y, b)\nrel out(n, v) = value(ROOT, v), nation(0, n, _)", "name total", "SELECT n_name AS name, 23 AS total FROM nation WHERE n_nationkey = 0")
query("adt_new", NATION, "type Box = Empty() | Full(String, i32)\nrel box(new Full(n, k)) = nation(k, n, r), r == 2\nrel out(n, k) = box(b), case b is Full(n, k)", "name nationkey", "SELECT n_name AS name, n_nationkey AS nationkey FROM nation WHERE n_regionkey = 2")


query("parse_entity", {"told": "part: p_partkey; concat('Tie(Knot(', p_size, '), Tie(Knot(1), Knot(', p_partkey % 7, ')))')"}, "type Rope = Knot(i32) | Tie(Rope, Rope)\nrel rope(k, $parse_entity(t)) = told(k, t)\nrel load(r, n) = case r is Knot(n)\nrel load(r, a + b) = case r is Tie(x, y) and load(x, a) and load(y, b)\nrel out(k, n) = rope(k, r), load(r, n)", "partkey total", "SELECT p_partkey AS partkey, CAST(p_size + 1 + p_partkey % 7 AS INTEGER) AS total FROM part")
query("tensor_shape", {"vec": "embeddings: vec_id; array(transform(embedding, x -> cast(x as double)))"}, "rel out(k, $dim(v), d, n) = vec(k, v), tensor_shape(v, d, n)", "vec_id dims dim size", "SELECT vec_id, 2 AS dims, d AS dim, CASE WHEN d = 0 THEN 1 ELSE len(embedding) END AS size FROM embeddings, (VALUES (0), (1)) AS t(d)")

# sources, extensions and the rest

@python("csv_roundtrip", "SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a relation as CSV through a query's attribute and read it again."""
    path = scratch_path(spark, "csv")
    p = load(Program(spark), sf_dir, NATION).add(f'rel copied(k, n, r) = nation(k, n, r)\n@file("{path}", deliminator="|")\nquery copied')
    p.run()
    q = Program(spark).add(f'@file("{path}", deliminator="|")\ntype back(i32, String, i32)')
    return q.relation("back", ["nationkey", "name", "regionkey"])


@python("csv_unpivot_keys", "SELECT CAST(n_nationkey AS VARCHAR) AS id, field, value FROM (SELECT n_nationkey, 'n_name' AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation)")
def csv_unpivot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.option("header", True).csv(path)
    p = Program(spark).add(f'@file("{path}", has_header=true, keys="n_nationkey")\ntype long(id: String, field: Symbol, value: String)')
    return p.relation("long", ["id", "field", "value"])


@python("csv_fields", "SELECT n_name AS name, n_regionkey AS regionkey FROM nation")
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.option("header", True).csv(path)
    p = Program(spark).add(f'@file("{path}", has_header=true, fields=["n_name", "n_regionkey"])\ntype part(String, i32)')
    return p.relation("part", ["name", "regionkey"])


@python("csv_prob", "SELECT r_regionkey AS regionkey, CAST(r_regionkey / CAST(10 AS DOUBLE) AS DOUBLE) AS tag FROM region")
def csv_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey / 10D", "r_regionkey").write.csv(path)
    p = Program(spark, "minmaxprob").add(f'@file("{path}", has_probability=true)\ntype r(i32)')
    return p.relation("r", ["regionkey"])


@python("udf_scalar", "SELECT n_name AS name, reverse(n_name) AS turned FROM nation")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(Program(spark), sf_dir, NATION).function("turned", ["String"], "String", python=lambda s: s[::-1])
    return p.add("rel out(n, $turned(n)) = nation(_, n, _)").relation("out", ["name", "turned"])


@python("udtf_lateral", "SELECT n_name AS name, CAST(unnest(range(0, n_regionkey)) AS INTEGER) AS i FROM nation")
def udtf_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(Program(spark), sf_dir, NATION).predicate("below", ["i32"], ["i32"], lambda n: list(range(n)))
    return p.add("rel out(n, i) = nation(_, n, r), below(r, i)").relation("out", ["name", "i"])


@python("udaf_custom", "SELECT p_brand AS brand, CAST(median(p_size) AS DOUBLE) AS middle FROM part GROUP BY p_brand")
def udaf_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(Program(spark), sf_dir, PART).aggregate("median", "f64", lambda k, s: F.median(s))
    return p.add("rel out(b, m) = m := median[k](s: part(k, b, _, s, _))").relation("out", ["brand", "middle"])


query("tensor_dot", {"vec": "embeddings: vec_id; transform(embedding, x -> cast(x as double))"}, "rel out(k, $dot(v, v)) = vec(k, v)", "vec_id norm", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm FROM embeddings", digits=6)


@python("input_mapping", "SELECT vec_id, i - 1 AS dim, round(CAST(embedding[i] AS DOUBLE), 6) AS tag FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY CAST(embedding[i] AS DOUBLE) DESC, i) <= 3")
def input_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimensions of a vector as weighted facts, of which the heaviest three stay."""
    dims = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("dim", "w")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.col("w").cast("double").alias("w"))
    p = Program(spark, "minmaxprob").add_table("dims", dims, "w").add("rel out(v, d) = d := top<3>(d: dims(v, d))")
    return p.relation("out", ["vec_id", "dim"]).withColumn("tag", F.round("tag", 6))


@python("incremental_add_facts", f"WITH RECURSIVE {EDGES_SQL}, e2 AS (SELECT a, b FROM edge UNION SELECT 100, 0 UNION SELECT 39, 200), r AS (SELECT b FROM e2 WHERE a = 100 UNION SELECT e2.b FROM r JOIN e2 ON r.b = e2.a) SELECT b AS node FROM r")
def incremental_add_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(Program(spark), sf_dir, EDGES).add("rel reach(y) = edge(100, y) or (reach(x) and edge(x, y))")
    p.relation("reach")
    p.add_facts("edge", [(100, 0), (39, 200)])
    return p.relation("reach", ["node"])


@python("batch_run", f"WITH RECURSIVE {EDGES_SQL}, s AS (SELECT r_regionkey AS batch, r_regionkey AS x FROM region), r AS (SELECT batch, x FROM s UNION SELECT r.batch, e.b FROM r JOIN edge e ON r.x = e.a) SELECT batch, x AS node FROM r")
def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(Program(spark), sf_dir, EDGES).add("type start(i32)\nrel reach(x) = start(x)\nrel reach(y) = reach(x), edge(x, y)")
    starts = spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey as batch", "r_regionkey as x")
    return p.batch({"start": starts}, "reach", "batch", ["node"])


@python("atomic_query", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation WHERE n_regionkey = 1")
def atomic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(Program(spark), sf_dir, NATION).add("rel all(k, n, r) = nation(k, n, r)\nquery all(k, n, 1)")
    return p.query(columns=["k", "name", "r"])


@python("flagship_regions", "SELECT r_name AS region, count(DISTINCT c_custkey) AS customers, count(DISTINCT n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def flagship_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(Program(spark), sf_dir, NATION | CUSTOMER)
    p.add("rel lives(c, n, r) = customer(c, n, _, _), nation(n, _, g), region(g, r)\nrel people(r, k) = k := count(c: lives(c, _, r))\nrel lands(r, k) = k := count(n: lives(_, n, r))\nrel out(r, a, b) = people(r, a), lands(r, b)")
    return p.relation("out", ["region", "customers", "nations"])
