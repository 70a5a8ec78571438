"""Registered queries: each operator of the engine on the star schema, with SQL for the same rows.

A query is a program of one of the two languages over tables whose columns are
renamed and cast to the declared types; integers are 64-bit throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import engine_session
from .plans.rule_run import evaluate as evaluate_rules
from .streaming.session import StreamSession
from .streaming.session import evaluate as evaluate_streams

#: relation -> (table, {column: table's column}).
SOURCES = {
    "region": ("region", {"id": "r_regionkey", "name": "r_name"}),
    "nation": ("nation", {"id": "n_nationkey", "name": "n_name", "region": "n_regionkey"}),
    "customer": ("customer", {"id": "c_custkey", "name": "c_name", "nation": "c_nationkey", "bal": "c_acctbal", "seg": "c_mktsegment"}),
    "supplier": ("supplier", {"id": "s_suppkey", "name": "s_name", "nation": "s_nationkey"}),
    "part": ("part", {"id": "p_partkey", "name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}),
    "orders": ("orders", {"id": "o_orderkey", "cust": "o_custkey", "status": "o_orderstatus", "price": "o_totalprice", "at": "o_orderdate", "prio": "o_orderpriority"}),
    "line": ("lineitem", {"order": "l_orderkey", "num": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey", "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "flag": "l_returnflag", "status": "l_linestatus", "at": "l_shipdate"}),
    "events": ("events", {"id": "event_id", "at": "ts", "user": "user_id", "kind": "event_type", "value": "value", "props": "props"}),
    "docs": ("documents", {"id": "doc_id", "text": "text", "lang": "lang", "source": "source"}),
}
TYPES = {
    "region": "id: i64, name: string", "nation": "id: i64, name: string, region: i64", "customer": "id: i64, name: string, nation: i64, bal: f64, seg: string",
    "supplier": "id: i64, name: string, nation: i64", "part": "id: i64, name: string, brand: string, kind: string, size: i64, price: f64",
    "orders": "id: i64, cust: i64, status: string, price: f64, at: timestamp, prio: string",
    "line": "order: i64, num: i64, part: i64, supp: i64, qty: f64, price: f64, disc: f64, flag: string, status: string, at: timestamp",
    "events": "id: i64, at: timestamp, user: i64, kind: string, value: f64, props: json", "docs": "id: i64, text: string, lang: string, source: string",
}


#: Keys of the tables; order and line number don't identify a line.
KEYS = {n: ("id",) for n in SOURCES if n != "line"}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation's rows; the JSON texts of ``props`` are canonical as stored but for blanks."""
    table, columns = SOURCES[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*[F.col(c).alias(n) for n, c in columns.items()])
    return df.withColumn("props", F.to_json(F.try_parse_json("props"))) if name == "events" else df


def rules(program: str, tables: tuple[str, ...], spark: SparkSession, sf_dir: str, out: str = "out") -> DataFrame:
    """Run a program of the rule language; inputs are declared from ``TYPES``."""
    heads = "".join(f"{n} :: relation({TYPES[n]})\n{n}({', '.join(c + ':' for c in SOURCES[n][1])}) <- input\n" for n in tables)
    own = engine_session(spark)
    return evaluate_rules(spark, heads + program, {n: source(own, sf_dir, n) for n in tables}, keys={t: KEYS[t] for t in tables if t in KEYS})[out]


def streams(program: str, tables: tuple[str, ...], spark: SparkSession, sf_dir: str, out: str = "out") -> DataFrame:
    """Run a program of the stream language for one transaction; columns of the rows, of keys and values, and ``weight``."""
    heads = "".join(f"{n} :: zset(record({TYPES[n]}))\n{n} := input(\"{n}\")\n" for n in tables)
    own = engine_session(spark)
    got = evaluate_streams(spark, heads + program, {n: source(own, sf_dir, n) for n in tables}, [out])[out]
    return flat(got)


def flat(got: DataFrame) -> DataFrame:
    """A batch with its records' fields as columns; weights of equal rows are summed."""
    cols = []
    for side in ("k", "v"):
        if side in got.columns:
            kind = got.schema[side].dataType
            cols += [F.col(side)[f.name].alias(f.name) for f in kind.fields] if hasattr(kind, "fields") else [F.col(side).alias({"k": "key", "v": "value"}[side])]
    flat_df = got.select(*cols, F.col("w").alias("weight"))
    keys = [c for c in flat_df.columns if c != "weight"]
    return flat_df.groupBy(*keys).agg(F.sum("weight").alias("weight")).where("weight <> 0")


RULES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "filter_orders": (("orders",), 'out(id: i, price: p) <-\n    orders(id: i, price: p, prio: "1-URGENT")\n    p > 100000.0', "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000"),
    "map_projection": (("part",), "out(id: i, twice: s * 2, label: b ++ \"/\" ++ k) <- part(id: i, size: s, brand: b, kind: k)", "SELECT p_partkey AS id, (p_size * 2)::BIGINT AS twice, p_brand || '/' || p_type AS label FROM part"),
    "join_orders_customer": (("orders", "customer"), "out(order: o, name: n) <-\n    orders(id: o, cust: c, price: p)\n    customer(id: c, name: n)\n    p >= 200000.0", "SELECT o_orderkey AS \"order\", c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 200000"),
    "join_three_way": (("region", "nation", "customer"), "out(region: r, n: count<>) <-\n    region(id: k, name: r)\n    nation(id: m, region: k)\n    customer(id: c, nation: m)", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "self_join_same_nation": (("supplier",), "out(a: x, b: y) <-\n    supplier(id: x, nation: n)\n    supplier(id: y, nation: n)\n    x < y", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"),
    "theta_join_shipdate": (("orders", "line"), "out(flag: f, n: count<>) <-\n    orders(id: o, at: a)\n    line(order: o, num: k, at: s, flag: f)\n    s > a + temporal:interval(days: 60)", "SELECT flag, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_orderdate, l_linenumber, l_shipdate, l_returnflag AS flag FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY) GROUP BY 1"),
    "cross_region_pairs": (("region",), "out(a: x, b: y) <-\n    region(name: x)\n    region(name: y)", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b"),
    "semi_existential": (("customer", "orders"), "out(id: c) <-\n    customer(id: c)\n    orders(cust: c, status: \"F\")", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "antijoin_customers_without_orders": (("customer", "orders"), "out(id: c, seg: s) <-\n    customer(id: c, seg: s)\n    not orders(cust: c)", "SELECT c_custkey AS id, c_mktsegment AS seg FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "union_rules": (("customer", "supplier"), 'out(nation: n, side: "c") <-\n    customer(nation: n, bal: b)\n    b < 0.0\nout(nation: n, side: "s") <- supplier(nation: n)', "SELECT c_nationkey::BIGINT AS nation, 'c' AS side FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey::BIGINT, 's' FROM supplier"),
    "intersect_nations": (("customer", "supplier"), "out(nation: n) <-\n    customer(nation: n, seg: \"BUILDING\")\n    supplier(nation: n)", "SELECT c_nationkey::BIGINT AS nation FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey::BIGINT FROM supplier"),
    "distinct_priority": (("orders",), "out(prio: p) <- orders(prio: p)", "SELECT DISTINCT o_orderpriority AS prio FROM orders"),
    "agg_count": (("orders",), "out(prio: p, n: count<>) <- orders(id: _i, prio: p)", "SELECT o_orderpriority AS prio, count(*) AS n FROM orders GROUP BY 1"),
    "agg_sum": (("line",), "out(flag: f, qty: s) <-\n    line(order: _o, num: _n, flag: f, qty: q)\n    s := sum<q>", "SELECT flag, sum(qty) AS qty FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag AS flag, l_quantity AS qty FROM lineitem) GROUP BY 1"),
    "agg_avg_trunc": (("part",), "out(brand: b, mean: avg<s>, low: avg<d>) <-\n    part(id: _i, brand: b, size: s)\n    d := 20 - s", "SELECT p_brand AS brand, (sum(p_size) // count(*))::BIGINT AS mean, trunc(sum(20 - p_size) / count(*))::BIGINT AS low FROM part GROUP BY 1"),
    "agg_min_max": (("orders",), "out(cust: c, low: min<p>, high: max<a>) <- orders(id: _i, cust: c, price: p, at: a)", "SELECT o_custkey AS cust, min(o_totalprice) AS low, max(o_orderdate) AS high FROM orders GROUP BY 1"),
    "argmin_cheapest_part": (("part",), "out(brand: b, id: argmin<i, by: p>) <- part(id: i, brand: b, price: p)", "SELECT p_brand AS brand, min(p_partkey) AS id FROM part JOIN (SELECT p_brand AS b, min(p_retailprice) AS m FROM part GROUP BY 1) ON p_brand = b AND p_retailprice = m GROUP BY 1"),
    "argmax_latest_order_tie": (("orders",), "out(cust: c, id: argmax<i, by: a>) <- orders(id: i, cust: c, at: a)", "SELECT o_custkey AS cust, min(o_orderkey) AS id FROM orders JOIN (SELECT o_custkey AS c, max(o_orderdate) AS m FROM orders GROUP BY 1) ON o_custkey = c AND o_orderdate = m GROUP BY 1"),
    "argmax_by_text": (("nation",), "out(region: r, id: argmax<i, by: n>) <- nation(id: i, name: n, region: r)", "SELECT n_regionkey::BIGINT AS region, arg_max(n_nationkey, n_name)::BIGINT AS id FROM nation GROUP BY 1"),
    "global_aggregate": (("line",), "out(n: count<>, most: max<q>) <- line(order: _o, num: _n, qty: q)", "SELECT count(*) AS n, max(q) AS most FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem)"),
    "multi_agg_one_group": (("orders",), "out(status: s, n: count<>, low: min<p>, high: max<p>, first: argmin<i, by: a>) <- orders(id: i, status: s, price: p, at: a)", "SELECT o_orderstatus AS status, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, (SELECT min(o_orderkey) FROM orders i WHERE i.o_orderstatus = o.o_orderstatus AND o_orderdate = min(o.o_orderdate)) AS first FROM orders o GROUP BY 1"),
    "group_by_expression_vars": (("nation",), "out(len: string:length(n), total: s) <-\n    nation(id: i, name: n)\n    s := sum<i>", "SELECT DISTINCT length(n_name)::BIGINT AS len, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY n_name"),
    "assignment_set_sum": (("part",), "out(total: s) <-\n    part(size: z)\n    s := sum<z>", "SELECT sum(z)::BIGINT AS total FROM (SELECT DISTINCT p_size AS z FROM part)"),
    "division_drops_row": (("part",), "out(id: i, q: 100 / d, r: 100 % d) <-\n    part(id: i, size: s)\n    d := s - 10", "SELECT p_partkey AS id, trunc(100.0 / (p_size - 10))::BIGINT AS q, (100 % (p_size - 10))::BIGINT AS r FROM part WHERE p_size <> 10"),
    "int_div_mod_truncation": (("nation",), "out(id: i, q: (i - 12) / 5, r: (i - 12) % 5) <- nation(id: i)", "SELECT n_nationkey::BIGINT AS id, trunc((n_nationkey - 12) / 5.0)::BIGINT AS q, ((n_nationkey - 12) % 5)::BIGINT AS r FROM nation"),
    "temporal_components": (("orders",), "out(id: i, y: temporal:years(a), m: temporal:months(a), d: temporal:days(a), us: temporal:epoch_micros(a), day: temporal:date(a)) <- orders(id: i, at: a)", "SELECT o_orderkey AS id, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, epoch_us(o_orderdate) AS us, o_orderdate::DATE AS day FROM orders"),
    "event_clock": (("events",), "out(id: i, h: temporal:hours(a), m: temporal:minutes(a), s: temporal:seconds(a), us: temporal:microseconds(a)) <- events(id: i, at: a)", "SELECT event_id AS id, hour(ts)::BIGINT AS h, minute(ts)::BIGINT AS m, second(ts)::BIGINT AS s, (microsecond(ts) % 1000000)::BIGINT AS us FROM events"),
    "date_shift_truncates": (("orders",), "out(id: i, up: d + temporal:interval(hours: 30), same: d - temporal:interval(hours: 23)) <-\n    orders(id: i, at: a)\n    d := temporal:date(a)", "SELECT o_orderkey AS id, (o_orderdate::DATE + 1)::DATE AS up, o_orderdate::DATE AS same FROM orders"),
    "ts_difference_micros": (("orders", "line"), "out(order: o, num: n, days: temporal:total_days(s - a), us: temporal:total_microseconds(s - a)) <-\n    orders(id: o, at: a)\n    line(order: o, num: n, at: s)", "SELECT DISTINCT l_orderkey AS \"order\", l_linenumber::BIGINT AS num, trunc((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0)::BIGINT AS days, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) AS us FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "string_builtins": (("part",), 'out(id: i, n: string:length(a), up: string:upper(a), low: string:lower(b), t: string:trim("  " ++ a ++ " ")) <- part(id: i, name: a, brand: b)', "SELECT p_partkey AS id, length(p_name)::BIGINT AS n, upper(p_name) AS up, lower(p_brand) AS low, trim(p_name) AS t FROM part"),
    "string_functions": (("part",), 'out(id: i, has: string:contains(a, sub: "a"), pre: string:starts_with(a, prefix: "p"), at: string:at(b, index: 1), rep: string:replace(b, from: "#", to: "-"), parts: array:length(string:split(k, delimiter: " "))) <- part(id: i, name: a, brand: b, kind: k)', "SELECT p_partkey AS id, contains(p_name, 'a') AS has, starts_with(p_name, 'p') AS pre, p_brand[2] AS at, replace(p_brand, '#', '-') AS rep, len(string_split(p_type, ' '))::BIGINT AS parts FROM part"),
    "bytes_hex_base64": (("nation",), 'out(id: i, hex: bytes:to_hex(b), b64: bytes:to_base64(b), n: bytes:length(b), back: bytes:to_string(c)) <-\n    nation(id: i, name: n)\n    b := bytes:from_string(n)\n    c := bytes:concat(b, bytes:from_string("!"))', "SELECT n_nationkey::BIGINT AS id, lower(hex(n_name::BLOB)) AS hex, base64(n_name::BLOB) AS b64, octet_length(n_name::BLOB)::BIGINT AS n, n_name || '!' AS back FROM nation"),
    "json_narrow": (("events",), 'out(id: i, k: k) <-\n    events(id: i, props: p)\n    p :: dict(string, json)\n    {"k": v, **} := p\n    k := v\n    k :: i64', "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')"),
    "dict_literal_lookup": (("orders",), 'out :: relation(id: i64, w: i64)\nout(id: i, w: {"O" => 1, "F" => 2}[s]) <- orders(id: i, status: s)', "SELECT o_orderkey AS id, (CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END)::BIGINT AS w FROM orders WHERE o_orderstatus IN ('O', 'F')"),
    "array_slice_python": (("nation",), "out(id: i, a: x[1:3], b: x[::-1], c: x[-2:]) <-\n    nation(id: i, region: r)\n    x := [i, r, i + r, i * r]", "SELECT n_nationkey::BIGINT AS id, [r, i + r] AS a, [i * r, i + r, r, i] AS b, [i + r, i * r] AS c FROM (SELECT n_nationkey, n_nationkey::BIGINT AS i, n_regionkey::BIGINT AS r FROM nation)"),
    "array_functions": (("nation",), "out(id: i, s: array:sort(x), m: array:max(x), d: array:length(array:distinct(x)), has: array:contains(x, element: 3), at: array:index_of(x, element: r)) <-\n    nation(id: i, region: r)\n    x := [i, r, i + r]", "SELECT i AS id, list_sort([i, r, i + r]) AS s, greatest(i, r, i + r) AS m, len(list_distinct([i, r, i + r]))::BIGINT AS d, list_contains([i, r, i + r], 3) AS has, (list_position([i, r, i + r], r) - 1)::BIGINT AS at FROM (SELECT n_nationkey::BIGINT AS i, n_regionkey::BIGINT AS r FROM nation)"),
    "destructure_array": (("docs",), "out(id: i, first: a, more: array:length(r)) <-\n    docs(id: i, source: s)\n    [a, *r] := string:split(s, delimiter: \"c\")", "SELECT doc_id AS id, string_split(source, 'c')[1] AS first, (len(string_split(source, 'c')) - 1)::BIGINT AS more FROM documents"),
    "destructure_record": (("nation",), "out(id: a, rest: e.y) <-\n    nation(id: i, region: r)\n    record(x: a, **e) := record(x: i, y: r)", "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS rest FROM nation"),
    "unnest_index": (("nation",), 'out(id: i, at: k, word: w) <-\n    nation(id: i, name: n)\n    (k, w) := *string:split(n, delimiter: "A")', "SELECT n_nationkey::BIGINT AS id, (k - 1)::BIGINT AS at, string_split(n_name, 'A')[k] AS word FROM nation, unnest(range(1, len(string_split(n_name, 'A')) + 1)) AS u(k)"),
    "unnest_dict": (("nation",), "out(id: i, key: k, v: v) <-\n    nation(id: i, region: r)\n    (k, v) := **{a: i, b: r, a: r}", "SELECT n_nationkey::BIGINT AS id, k AS key, n_regionkey::BIGINT AS v FROM nation, (VALUES ('a'), ('b')) AS t(k)"),
    "negation_stratified": (("nation", "customer", "supplier"), "served(n: n) <-\n    customer(nation: n)\n    supplier(nation: n)\nout(id: i) <-\n    nation(id: i)\n    not served(n: i)", "SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
    "recursion_tc": (("nation",), "edge(src: i, dst: (3 * i + 1) % 25) <- nation(id: i)\nout(src: x, dst: y) <- edge(src: x, dst: y)\nout(src: x, dst: y) <-\n    out(src: x, dst: z)\n    edge(src: z, dst: y)", "WITH RECURSIVE edge AS (SELECT n_nationkey::BIGINT AS src, ((3 * n_nationkey + 1) % 25)::BIGINT AS dst FROM nation), tc AS (SELECT src, dst FROM edge UNION SELECT tc.src, edge.dst FROM tc JOIN edge ON tc.dst = edge.src) SELECT * FROM tc"),
    "recursion_mutual": (("nation",), "next(a: i, b: j) <-\n    nation(id: i)\n    nation(id: j)\n    j = i + 1\neven(n: 0) <- nation(id: 0)\neven(n: y) <-\n    odd(n: x)\n    next(a: x, b: y)\nodd(n: y) <-\n    even(n: x)\n    next(a: x, b: y)\nout(n: n, kind: \"even\") <- even(n: n)\nout(n: n, kind: \"odd\") <- odd(n: n)", "SELECT n_nationkey::BIGINT AS n, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM nation"),
    "constant_facts_join": (("orders",), 'rank :: relation(prio: string, n: i64)\nrank(prio: "1-URGENT", n: 1)\nrank(prio: "2-HIGH", n: 1 + 1)\nout(n: k, orders: count<>) <-\n    orders(id: _i, prio: p)\n    rank(prio: p, n: k)', "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 2 END::BIGINT AS n, count(*) AS orders FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1"),
    "proposition_guard": (("region", "nation"), 'ready :: relation()\nready() <- region(name: "ASIA")\nout(id: i) <-\n    nation(id: i)\n    ready()', "SELECT n_nationkey::BIGINT AS id FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')"),
    "proposition_negated": (("region", "nation"), 'big :: relation()\nbig() <-\n    nation(id: i)\n    i > 1000\nout(id: i) <-\n    nation(id: i)\n    not big()', "SELECT n_nationkey::BIGINT AS id FROM nation WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 1000)"),
    "pricing_summary": (("line",), "out(flag: f, status: s, n: count<>, qty: sum<q>, high: max<p>, low: min<d>) <-\n    line(order: _o, num: _n, flag: f, status: s, qty: q, price: p, disc: d, at: a)\n    a <= c\n    c := temporal:timestamp(\"1998-09-02\")", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS qty, max(l_extendedprice) AS high, min(l_discount) AS low FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_shipdate FROM lineitem) WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "revenue_by_nation": (("nation", "customer", "orders", "line"), "out(nation: n, revenue: float:round(v)) <-\n    nation(id: k, name: n)\n    customer(id: c, nation: k)\n    orders(id: o, cust: c)\n    line(order: o, num: _l, price: p, disc: d)\n    v := sum<p * (1.0 - d)>", "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount))) AS revenue FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1"),
}
_KEYED = "ci := map_index(customer, function((r) -> record(key: r.id, value: record(name: r.name, seg: r.seg))))\noi := map_index(orders, function((r) -> record(key: r.cust, value: record(id: r.id, price: r.price))))\n"
STREAMS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "stream_map_filter": (("part",), "out := map(filter(part, function((r) -> r.size > 25 and not (r.brand == \"Brand#11\"))), function((r) -> record(brand: r.brand, half: coalesce(r.size / 2, 0))))", "SELECT p_brand AS brand, (p_size // 2)::BIGINT AS half, count(*) AS weight FROM part WHERE p_size > 25 AND p_brand <> 'Brand#11' GROUP BY 1, 2"),
    "flat_map_split": (("nation",), "out := flat_map(nation, function((r) -> map_array([r.id, r.region], function((e, i) -> record(name: r.name, at: i, v: e)))))", "SELECT n_name AS name, \"at\", v, count(*) AS weight FROM (SELECT n_name, 0::BIGINT AS \"at\", n_nationkey::BIGINT AS v FROM nation UNION ALL SELECT n_name, 1, n_regionkey FROM nation) GROUP BY 1, 2, 3"),
    "flat_map_index_counts": (("nation",), "fi := flat_map_index(nation, function((r) -> [record(key: r.region, value: r.id), record(key: 99, value: r.id)]))\nout := aggregate(fi, count, function((v) -> v))", "SELECT k AS key, count(*) AS value, 1::BIGINT AS weight FROM (SELECT n_regionkey::BIGINT AS k FROM nation UNION ALL SELECT 99 FROM nation) GROUP BY 1"),
    "map_array_transform": (("nation",), "out := map(nation, function((r) -> record(id: r.id, xs: map_array([1, 2, 3], function((e, i) -> e * r.id + i)))))", "SELECT n_nationkey::BIGINT AS id, [n_nationkey::BIGINT, 2 * n_nationkey + 1, 3 * n_nationkey + 2] AS xs, 1::BIGINT AS weight FROM nation"),
    "filter_array": (("nation",), "out := map(nation, function((r) -> record(id: r.id, xs: filter_array([r.id, r.region, 7], function((e) -> e > 3)))))", "SELECT n_nationkey::BIGINT AS id, list_filter([n_nationkey::BIGINT, n_regionkey::BIGINT, 7], lambda x: x > 3) AS xs, 1::BIGINT AS weight FROM nation"),
    "left_join_pattern": (("customer", "orders"), _KEYED + "matched := join(ci, oi, function((k, c, o) -> record(id: k, order: cast(o.id, optional(i64)))))\nnulled := map(antijoin(ci, oi), function((k, c) -> record(id: k, order: cast(NONE, optional(i64)))))\nout := plus(matched, nulled)", "SELECT c_custkey AS id, o_orderkey AS \"order\", 1::BIGINT AS weight FROM customer LEFT JOIN orders ON o_custkey = c_custkey"),
    "join_index_sum": (("customer", "orders"), _KEYED + "ji := join_index(ci, oi, function((k, c, o) -> record(key: c.seg, value: o.id)))\nout := aggregate(ji, sum, function((v) -> v))", "SELECT c_mktsegment AS key, sum(o_orderkey)::BIGINT AS value, 1::BIGINT AS weight FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "minus_bag": (("customer", "supplier"), "a := map(customer, function((r) -> record(nation: r.nation)))\nb := map(supplier, function((r) -> record(nation: r.nation)))\nout := minus(a, plus(b, b))", "SELECT nation, sum(w)::BIGINT AS weight FROM (SELECT c_nationkey::BIGINT AS nation, 1 AS w FROM customer UNION ALL SELECT s_nationkey, -2 FROM supplier) GROUP BY 1 HAVING sum(w) <> 0"),
    "sum_neg_distinct": (("customer", "supplier"), "a := map(customer, function((r) -> record(nation: r.nation)))\nb := map(supplier, function((r) -> record(nation: r.nation)))\nout := distinct(sum(a, neg(b), neg(b), neg(b)))", "SELECT nation, 1::BIGINT AS weight FROM (SELECT c_nationkey::BIGINT AS nation, 1 AS w FROM customer UNION ALL SELECT s_nationkey, -3 FROM supplier) GROUP BY 1 HAVING sum(w) > 0"),
    "weighted_count_brand": (("part",), "out := weighted_count(map(part, function((r) -> r.brand)))", "SELECT p_brand AS key, count(*) AS value, 1::BIGINT AS weight FROM part GROUP BY 1"),
    "count_with_null_projection": (("part",), "pi := map_index(part, function((r) -> record(key: r.brand, value: if(r.size > 20, cast(r.size, optional(i64)), NONE))))\nout := aggregate(pi, count, function((v) -> v))", "SELECT p_brand AS key, count(CASE WHEN p_size > 20 THEN 1 END) AS value, 1::BIGINT AS weight FROM part GROUP BY 1"),
    "fixpoint_same_depth": (("nation",), "below := map_index(filter(nation, function((r) -> r.id > 0)), function((r) -> record(key: coalesce(r.id / 2, 0), value: record(id: r.id))))\ntop := map_index(filter(nation, function((r) -> r.id == 0)), function((r) -> record(key: r.id, value: record(peer: r.id))))\ncircuit generation(start: s, tree: t, peers: q) {\n    down := join_index(q, t, function((k, a, c) -> record(key: a.peer, value: record(one: c.id))))\n    level := join_index(down, t, function((k, a, c) -> record(key: a.one, value: record(peer: c.id))))\n    peers := plus(s, level)\n}\ng := fixpoint(generation(start: top, tree: below, peers: empty()))\nout := map(g.peers, function((k, v) -> record(a: k, b: v.peer)))", "WITH d AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 0 THEN 0 ELSE floor(log2(n_nationkey)) + 1 END AS depth FROM nation) SELECT a.id AS a, b.id AS b, 1::BIGINT AS weight FROM d AS a JOIN d AS b USING (depth)"),
    "narrow_optional": (("part",), "out := map(filter(map(part, function((r) -> record(id: r.id, q: 100 / (r.size - 10)))), function((r) -> r.q != NONE and r.q > 3)), function((r) -> record(id: r.id, q: coalesce(r.q, 0))))", "SELECT p_partkey AS id, trunc(100.0 / (p_size - 10))::BIGINT AS q, 1::BIGINT AS weight FROM part WHERE p_size <> 10 AND trunc(100.0 / (p_size - 10)) > 3"),
    "cast_string_i64": (("orders",), 'out := map(orders, function((r) -> record(id: r.id, n: cast(cast(r.id, string), optional(i64)), bad: cast(r.prio, optional(i64)), f: cast(r.id, f64))))', "SELECT o_orderkey AS id, o_orderkey AS n, NULL::BIGINT AS bad, o_orderkey::DOUBLE AS f, 1::BIGINT AS weight FROM orders"),
    "json_get_cast": (("events",), 'out := map(events, function((r) -> record(id: r.id, k: cast(get(r.props, "k"), optional(i64)), none: get(r.props, "absent") == NONE)))', "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS none, 1::BIGINT AS weight FROM events"),
    "dynamic_roundtrip": (("nation",), "out := map(nation, function((r) -> record(id: cast(cast(r.id, dynamic), optional(i64)), text: cast(cast(r.id, dynamic), optional(string)), tag: cast(r.name, dynamic) == cast(r.name, dynamic))))", "SELECT n_nationkey::BIGINT AS id, NULL::VARCHAR AS text, true AS tag, 1::BIGINT AS weight FROM nation"),
    "constant_stream_join": (("nation",), "c :: zset(record(id: i64, label: string))\nc := constant([record(id: 1, label: \"one\"), record(id: 2, label: \"two\"), record(id: 2, label: \"two\")])\nni := map_index(nation, function((r) -> record(key: r.id, value: r.name)))\nout := join(ni, map_index(c, function((r) -> record(key: r.id, value: r.label))), function((k, n, l) -> record(name: n, label: l)))", "SELECT n_name AS name, label, sum(w)::BIGINT AS weight FROM nation JOIN (VALUES (1, 'one', 1), (2, 'two', 2)) AS c(id, label, w) ON n_nationkey = id GROUP BY 1, 2"),
    "circuit_template": (("part",), "function scale(x) { return x * 2 + 1 }\ncircuit big(src: s) {\n    kept := filter(s, function((r) -> r.size > 40))\n    out := map(kept, function((r) -> record(size: scale(r.size), price: scale(r.price))))\n}\nb := big(src: part)\nout := b.out", "SELECT (p_size * 2 + 1)::BIGINT AS size, p_retailprice * 2 + 1 AS price, count(*) AS weight FROM part WHERE p_size > 40 GROUP BY 1, 2"),
    "argmin_stream": (("orders",), "oi := map_index(orders, function((r) -> record(key: r.status, value: r)))\nout := aggregate(oi, argmin, function((v) -> record(by: v.price, value: v.id)))", "SELECT o_orderstatus AS key, (SELECT min(o_orderkey) FROM orders i WHERE i.o_orderstatus = o.o_orderstatus AND o_totalprice = min(o.o_totalprice)) AS value, 1::BIGINT AS weight FROM orders o GROUP BY 1"),
    "temporal_text": (("events",), 'out := map(events, function((r) -> record(id: r.id, t: cast(r.at, string), d: cast(cast(r.at, date), string), back: cast(cast(r.at, string), optional(timestamp)) == r.at)))', "SELECT event_id AS id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0') END AS t, strftime(ts, '%Y-%m-%d') AS d, true AS back, 1::BIGINT AS weight FROM events"),
}


def delta_session_insert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arrive, those of status F are retracted; the accumulated counts by priority after both transactions."""
    program = f"orders :: zset(record({TYPES['orders']}))\norders := input(\"orders\")\nout := weighted_count(map(orders, function((r) -> r.prio)))\n"
    s = StreamSession(spark, program, ["out"])
    df = source(s.spark, sf_dir, "orders")
    s.step({"orders": df})
    s.step({"orders": df.where("status = 'F'").withColumn("_w", F.lit(-1))})
    return flat(s.snapshot("out"))


def integrate_delay_differentiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second transaction's changes of an integral, a delay and a derivative of nations by region."""
    program = f"nation :: zset(record({TYPES['nation']}))\nnation := input(\"nation\")\nr := map(nation, function((r) -> record(region: r.region)))\n" "i := map(integrate(r), function((x) -> record(what: \"i\", region: x.region)))\nd := map(delay(r), function((x) -> record(what: \"d\", region: x.region)))\nf := map(differentiate(r), function((x) -> record(what: \"f\", region: x.region)))\nout := sum(i, d, f)\n"
    s = StreamSession(spark, program, ["out"])
    df = source(s.spark, sf_dir, "nation")
    s.step({"nation": df.where("id < 10")})
    return flat(s.step({"nation": df.where("id >= 10")})["out"])


def offset_segment_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users present in a log of arrivals and departures by event, with the offset that began their stay."""
    program = 'log :: zset(record(user: i64, part: i64, off: i64))\nlog := input("log", partition_as: "part", offset_as: "off")\nout := map(log, function((r) -> r))\n'
    s = StreamSession(spark, program, ["out"])
    events = s.spark.read.parquet(f"{sf_dir}/events.parquet")
    weight = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    return flat(s.step({"log": events.select(F.col("user_id").alias("user"), F.lit(0).alias("part"), F.col("event_id").alias("off"), weight.alias("_w"))})["out"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _name, (_tables, _program, _sql) in RULES.items():
    QUERIES[_name], SQL[_name] = partial(rules, _program, _tables), _sql
for _name, (_tables, _program, _sql) in STREAMS.items():
    QUERIES[_name], SQL[_name] = partial(streams, _program, _tables), _sql
QUERIES |= {"delta_session_insert_delete": delta_session_insert_delete, "integrate_delay_differentiate": integrate_delay_differentiate, "offset_segment_start": offset_segment_start}
SQL |= {
    "delta_session_insert_delete": "SELECT o_orderpriority AS key, count(*) AS value, 1::BIGINT AS weight FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
    "integrate_delay_differentiate": "SELECT what, region, sum(w)::BIGINT AS weight FROM (SELECT 'i' AS what, n_regionkey::BIGINT AS region, 1 AS w FROM nation UNION ALL SELECT 'd', n_regionkey, 1 FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'f', n_regionkey, CASE WHEN n_nationkey < 10 THEN -1 ELSE 1 END FROM nation) GROUP BY 1, 2 HAVING sum(w) <> 0",
    "offset_segment_start": "WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS w, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) SELECT user_id AS user, 0::BIGINT AS part, max(CASE WHEN s > 0 AND s - w <= 0 THEN event_id END) AS off, 1::BIGINT AS weight FROM r GROUP BY 1 HAVING sum(w) > 0",
}
