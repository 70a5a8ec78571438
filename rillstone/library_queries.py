"""Registered queries of the library functions, operators, conversions and session forms that ``queries`` leaves out."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import TYPES, flat, rules, source, streams
from .sources import codec
from .streaming.session import StreamSession

#: name -> (tables, program, SQL), as in ``queries``.
RULES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "library_integers": (
        ("nation",),
        "out(id: i, a: integer:abs(d), s: integer:sign(d), p: integer:pow(d, exponent: 3), lo: integer:min(d, r), hi: integer:max(d, r), n: boolean:not(d > 0)) <-\n    nation(id: i, region: r)\n    d := i - 12",
        "SELECT i AS id, abs(d) AS a, sign(d)::BIGINT AS s, (d * d * d)::BIGINT AS p, least(d, r) AS lo, greatest(d, r) AS hi, NOT (d > 0) AS n FROM (SELECT n_nationkey::BIGINT AS i, n_nationkey::BIGINT - 12 AS d, n_regionkey::BIGINT AS r FROM nation)",
    ),
    "library_floats": (
        ("customer",),
        "out(id: i, a: float:abs(b), f: float:floor(b), c: float:ceil(b), s: float:sign(b), q: float:sqrt(float:abs(b)), p: float:pow(b, exponent: 2.0), lo: float:min(b, 100.0), hi: float:max(b, 100.0)) <- customer(id: i, bal: b)",
        "SELECT c_custkey AS id, abs(b) AS a, floor(b) AS f, ceil(b) AS c, sign(b)::DOUBLE AS s, sqrt(abs(b)) AS q, pow(b, 2) AS p, least(b, 100) AS lo, greatest(b, 100) AS hi FROM (SELECT c_custkey, c_acctbal AS b FROM customer)",
    ),
    "library_strings": (
        ("nation",),
        'out(id: i, l: string:ltrim("  " ++ n ++ " "), r: string:rtrim(" " ++ n ++ "  "), part: string:slice(n, start: 1, stop: 4), e: string:ends_with(n, suffix: "A"), at: string:index_of(n, sub: "I"), c: string:concat(n, "!")) <- nation(id: i, name: n)',
        "SELECT n_nationkey::BIGINT AS id, n_name || ' ' AS l, ' ' || n_name AS r, n_name[2:4] AS part, ends_with(n_name, 'A') AS e, (strpos(n_name, 'I') - 1)::BIGINT AS at, n_name || '!' AS c FROM nation WHERE strpos(n_name, 'I') > 0",
    ),
    "library_arrays": (
        ("nation",),
        "out(id: i, a: array:at(x, index: 1), c: array:concat(x, [7]), ap: array:append(x, element: 8), pre: array:prepend(x, element: 9), rev: array:reverse(x), fl: array:flatten([x, [r]]), m: array:min(x)) <-\n    nation(id: i, region: r)\n    x := [i, r, i - r]",
        "SELECT i AS id, r AS a, [i, r, i - r, 7] AS c, [i, r, i - r, 8] AS ap, [9, i, r, i - r] AS pre, [i - r, r, i] AS rev, [i, r, i - r, r] AS fl, least(i, r, i - r) AS m FROM (SELECT n_nationkey::BIGINT AS i, n_regionkey::BIGINT AS r FROM nation)",
    ),
    "library_dicts": (
        ("nation",),
        'out(id: i, n: dict:length(d), h: dict:has(d, key: "b"), k: array:sort(dict:keys(d)), v: array:sort(dict:values(d)), less: dict:length(dict:without(d, keys: ["a"])), both: dict:length(dict:merge(d, {"c" => 1})), back: dict:get(dict:from_entries(dict:entries(d)), key: "b")) <-\n    nation(id: i, region: r)\n    d := {"a" => i, "b" => r}',
        "SELECT i AS id, 2::BIGINT AS n, true AS h, ['a', 'b'] AS k, list_sort([i, r]) AS v, 1::BIGINT AS less, 3::BIGINT AS both, r AS back FROM (SELECT n_nationkey::BIGINT AS i, n_regionkey::BIGINT AS r FROM nation)",
    ),
    "library_bytes": (
        ("nation",),
        'out(id: i, a: bytes:to_hex(bytes:and(b, m)), o: bytes:to_hex(bytes:or(b, m)), x: bytes:to_hex(bytes:xor(b, m)), f: bytes:to_string(bytes:from_base64(bytes:to_base64(c))), h: bytes:to_string(bytes:from_hex(bytes:to_hex(c)))) <-\n    nation(id: i, name: n)\n    c := bytes:from_string(n)\n    b := bytes:from_hex("0ff0")\n    m := bytes:from_hex("3c3c")',
        "SELECT n_nationkey::BIGINT AS id, '0c30' AS a, '3ffc' AS o, '33cc' AS x, n_name AS f, n_name AS h FROM nation",
    ),
    "library_temporal": (
        ("events",),
        "out(id: i, h: temporal:total_hours(v), m: temporal:total_minutes(v), s: temporal:total_seconds(v), t: temporal:hours(temporal:time(a)), back: temporal:epoch_micros(temporal:timestamp(date: temporal:date(a), time: temporal:time(a))), again: temporal:epoch_micros(temporal:timestamp(epoch_microseconds: temporal:epoch_micros(a))), y: temporal:years(temporal:date(year: 2024, month: 2, day: 29)), c: temporal:minutes(temporal:time(hour: 7, minute: 5))) <-\n    events(id: i, at: a)\n    v := temporal:interval(minutes: i)",
        "SELECT event_id AS id, (event_id // 60)::BIGINT AS h, event_id AS m, (event_id * 60)::BIGINT AS s, hour(ts)::BIGINT AS t, epoch_us(ts) AS back, epoch_us(ts) AS again, 2024::BIGINT AS y, 5::BIGINT AS c FROM events",
    ),
    "library_dynamic": (("nation",), "out(id: i) <-\n    nation(id: i, region: r)\n    dynamic:of(i) = dynamic:of(r)", "SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey = n_regionkey"),
    "float_arithmetic": (
        ("part",),
        "out(id: i, a: p + 0.5, s: p - 0.25, m: p * 2.0, d: p / 4.0, r: p % 7.0, n: -p, k: -z) <- part(id: i, price: p, size: z)",
        "SELECT p_partkey AS id, p_retailprice + 0.5::DOUBLE AS a, p_retailprice - 0.25::DOUBLE AS s, p_retailprice * 2 AS m, p_retailprice / 4 AS d, p_retailprice % 7.0::DOUBLE AS r, -p_retailprice AS n, -p_size::BIGINT AS k FROM part",
    ),
    "agg_avg_float": (
        ("part",),
        "out(brand: b, mean: float:round(m)) <-\n    part(id: _i, brand: b, price: p)\n    m := avg<p>",
        "SELECT p_brand AS brand, round(avg(p_retailprice)) AS mean FROM part GROUP BY 1",
    ),
    "ground_rule": (("region",), 'out :: relation(id: i64, name: string)\nout(id: 99, name: "NOWHERE")\nout(id: i, name: n) <- region(id: i, name: n)', "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region UNION ALL SELECT 99, 'NOWHERE'"),
}
STREAMS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "builtin_numbers": (
        ("customer",),
        "out := map(customer, function((r) -> record(id: r.id, a: abs(r.bal), f: floor(r.bal), c: ceil(r.bal), t: concat(r.seg, \"!\"), n: -r.id, h: r.bal / 2.0, m: r.bal % 3.0, w: cast(r.id, f64) * 0.5)))",
        "SELECT c_custkey AS id, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, c_mktsegment || '!' AS t, -c_custkey AS n, c_acctbal / 2 AS h, c_acctbal % 3.0::DOUBLE AS m, c_custkey * 0.5::DOUBLE AS w, 1::BIGINT AS weight FROM customer",
    ),
    "builtin_temporal": (
        ("nation",),
        "out := map(nation, function((r) -> record(id: r.id, d: cast(make_date(2024, 2, r.id + 5), optional(string)), t: cast(make_time(r.id, 5, 7, 0), optional(string)), n: epoch_days(cast(timestamp_from_micros(86400000000 * r.id), date)), us: epoch_micros(timestamp_from_micros(r.id)), h: total_hours(make_interval(7200000000 * r.id)), m: total_minutes(make_interval(60000000 * r.id)), s: total_seconds(make_interval(1000000 * r.id)))))",
        "SELECT i AS id, CASE WHEN i + 5 <= 29 THEN strftime(DATE '2024-02-05' + i::INTEGER, '%Y-%m-%d') END AS d, CASE WHEN i < 24 THEN lpad(i::VARCHAR, 2, '0') || ':05:07' END AS t, i AS n, i AS us, 2 * i AS h, i AS m, i AS s, 1::BIGINT AS weight FROM (SELECT n_nationkey::BIGINT AS i FROM nation)",
    ),
    "builtin_bytes": (
        ("nation",),
        'out := map(nation, function((r) -> record(id: r.id, a: cast(bytes_and(from_utf8("ab"), from_utf8("bb")) == from_utf8("bb"), string), x: bytes_xor(from_utf8("ab"), from_utf8("ab")) == from_hex("0000"), o: bytes_or(from_utf8("a"), from_utf8("b")) == from_utf8("c"), b: from_base64("YWI=") == from_utf8("ab"), bad: from_hex("xyz") == NONE)))',
        "SELECT n_nationkey::BIGINT AS id, 'false' AS a, true AS x, true AS o, true AS b, true AS bad, 1::BIGINT AS weight FROM nation",
    ),
    "builtin_documents": (
        ("events",),
        'out := map(events, function((r) -> record(id: r.id, k: keys({"p" => r.id, "q" => r.user}), n: length(dict_entries({"p" => r.id, "q" => r.user})), d: length(dict([record(key: "x", value: r.id)])), j: cast(cast(r.user, json), optional(i64)))))',
        "SELECT event_id AS id, ['p', 'q'] AS k, 2::BIGINT AS n, 1::BIGINT AS d, user_id AS j, 1::BIGINT AS weight FROM events",
    ),
    "cast_directions": (
        ("part",),
        'out := map(part, function((r) -> record(id: r.id, w: cast(r.price, optional(i64)), t: cast(cast(r.size, f64), string), b: cast("true", optional(bool)), nb: cast(r.brand, optional(bool)), f: cast("2.5", optional(f64)), nf: cast(r.brand, optional(f64)), d: cast(cast("2024-02-29", optional(date)), optional(string)), nd: cast("2023-02-29", optional(date)) == NONE, nt: cast("25:00:00", optional(time)) == NONE)))',
        "SELECT p_partkey AS id, trunc(p_retailprice)::BIGINT AS w, p_size::VARCHAR || '.0' AS t, true AS b, NULL::BOOLEAN AS nb, 2.5::DOUBLE AS f, NULL::DOUBLE AS nf, '2024-02-29' AS d, true AS nd, true AS nt, 1::BIGINT AS weight FROM part",
    ),
    "agg_avg_float_stream": (
        ("part",),
        "pi := map_index(part, function((r) -> record(key: r.brand, value: r.price)))\nm := aggregate(pi, avg, function((v) -> v))\nout := map(m, function((k, v) -> record(brand: k, mean: round(v))))",
        "SELECT p_brand AS brand, round(avg(p_retailprice)) AS mean, 1::BIGINT AS weight FROM part GROUP BY 1",
    ),
}


_BY_STATUS = f"orders :: zset(record({TYPES['orders']}))\norders := input(\"orders\")\nout := weighted_count(map(orders, function((r) -> r.status)))\n"


def explicit_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that arrive in two pushes of one transaction, then a transaction that takes the urgent ones back."""
    s = StreamSession(spark, _BY_STATUS, ["out"])
    df = source(s.spark, sf_dir, "orders")
    s.begin()
    s.push("orders", df.where("id % 2 = 0"))
    s.push("orders", df.where("id % 2 = 1"))
    s.commit()
    s.step({"orders": df.where("prio = '1-URGENT'").withColumn("_w", F.lit(-1))})
    return flat(s.snapshot("out"))


def checkpoint_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the orders, a checkpoint, a session restored from it, and the other half."""
    s = StreamSession(spark, _BY_STATUS, ["out"])
    df = source(s.spark, sf_dir, "orders")
    s.step({"orders": df.where("id % 2 = 0")})
    path = f"{s.scratch.root}/checkpoint"
    s.checkpoint(path)
    again = StreamSession.restore(spark, _BY_STATUS, ["out"], path)
    again.step({"orders": source(again.spark, sf_dir, "orders").where("id % 2 = 1")})
    return flat(again.snapshot("out"))


def json_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as changes in JSON, in both forms, read back and counted by region."""
    program = f"nation :: zset(record({TYPES['nation']}))\nnation := input(\"nation\")\nall := map(nation, function((r) -> r))\nout := weighted_count(map(nation, function((r) -> r.region)))\n"
    s = StreamSession(spark, program, ["all", "out"])
    lines = []
    for weight, row in s.collect({"all": s.step({"nation": source(s.spark, sf_dir, "nation")})["all"]})["all"]:
        form = "weighted" if row["id"] % 2 else "insert_delete"
        lines += [(form, json.dumps(x)) for x in codec.write_change(form, weight, row)]
    again = StreamSession(spark, program, ["out"])
    again.step({"nation": again.rows("nation", [codec.read_change(form, json.loads(x)) for form, x in lines])})
    return flat(again.snapshot("out"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"explicit_transaction": explicit_transaction, "checkpoint_restore": checkpoint_restore, "json_changes": json_changes}
SQL: dict[str, str] = {
    "explicit_transaction": "SELECT o_orderstatus AS key, count(*) AS value, 1::BIGINT AS weight FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1",
    "checkpoint_restore": "SELECT o_orderstatus AS key, count(*) AS value, 1::BIGINT AS weight FROM orders GROUP BY 1",
    "json_changes": "SELECT n_regionkey::BIGINT AS key, count(*) AS value, 1::BIGINT AS weight FROM nation GROUP BY 1",
}
for _name, (_tables, _program, _sql) in RULES.items():
    QUERIES[_name], SQL[_name] = partial(rules, _program, _tables), _sql
for _name, (_tables, _program, _sql) in STREAMS.items():
    QUERIES[_name], SQL[_name] = partial(streams, _program, _tables), _sql
