"""The HTTP host, Structured Streaming as a source, the codec and the command line."""

import json
import urllib.error
import urllib.request

import pytest

from rillstone.__main__ import main
from rillstone.sources import codec
from rillstone.streaming.driver import run_stream
from rillstone.streaming.server import Host, serve
from rillstone.streaming.session import StreamSession
from rillstone.types import BYTES, DATE, F64, I64, INTERVAL, JSON, STRING, TIME, TIMESTAMP, array, dict_of, optional, record

PROGRAM = 'a :: zset(record(k: string, v: i64))\na := input("a")\nout := weighted_count(map(a, function((r) -> r.k)))\n'


def call(server, path, body="", method="POST"):
    req = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=body.encode() if method == "POST" else None, method=method)
    try:
        with urllib.request.urlopen(req, timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_host(spark):
    server = serve(Host(StreamSession(spark, PROGRAM, ["out"]), materialized=frozenset(["out"])))
    try:
        status, got = call(server, "/ingress/a", '{"insert": {"k": "x", "v": 1}}\n{"insert": {"k": "x", "v": 2}}')
        assert status == 200 and call(server, f"/completion_status?token={got['token']}", method="GET") == (200, {"status": "complete"})
        assert call(server, "/egress/out")[1] == [{"sequence_number": 0, "snapshot": False, "json_data": [{"insert": {"key": "x", "value": 2}}]}]
        status, got = call(server, "/ingress/a?array=true", '[{"insert": {"k": "y", "v": 1}}, {"insert": {"k": 3, "v": 1}}, {"put": {}}]')
        assert status == 400 and len(got["details"]) == 2
        assert call(server, "/start_transaction")[0] == 200 and call(server, "/start_transaction")[0] == 409
        call(server, "/ingress/a", '{"delete": {"k": "x", "v": 1}}')
        call(server, "/ingress/a", '{"delete": {"k": "x", "v": 2}}')
        assert len(call(server, "/egress/out")[1]) == 2 and call(server, "/commit_transaction")[0] == 200
        rows = call(server, "/egress/out?snapshot=true")[1][0]["json_data"]
        assert rows == [{"weight": 1, "data": {"key": "y", "value": 1}}]
        assert call(server, "/ingress/zz", "{}")[0] == 404 and call(server, "/stats", method="GET")[1]["total_processed_records"] == 5
        assert call(server, "/metadata", method="GET")[1]["views"] == {"out": "indexed_zset(string, i64)"}
    finally:
        server.shutdown()


def test_micro_batches_are_transactions(spark, tmp_path):
    s = StreamSession(spark, PROGRAM, ["out"])
    for i in range(2):
        spark.createDataFrame([("x", i), ("y", i)], "k string, v long").write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = s.spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(s, "a", stream, lambda n, changes: got.append(s.collect(changes)["out"]), checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    assert len(got) >= 2
    assert sorted(s.collect({"out": s.snapshot("out")})["out"]) == [[1, "x", 2], [1, "y", 2]]


def test_batches_go_in_once(spark, tmp_path):
    """A batch whose sink failed is taken back and comes again; one that a restored session has had stays out."""
    for i in range(2):
        spark.createDataFrame([("x", i), ("y", i)], "k string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = StreamSession(spark, PROGRAM, ["out"])
    got, calls = [], []

    def sink(n, changes):
        calls.append(n)
        if len(calls) == 2:
            raise OSError("the sink is away")
        got.append(s.collect(changes)["out"])

    def run(session, cp, to=sink):
        stream = session.spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run_stream(session, "a", stream, to, checkpoint=str(tmp_path / cp), state=str(tmp_path / "state")).awaitTermination(120)

    with pytest.raises(Exception, match="the sink is away"):
        run(s, "cp")
    assert s.fed == {"a": 0} and sorted(s.collect({"out": s.snapshot("out")})["out"]) == [[1, "x", 1], [1, "y", 1]]
    run(s, "cp")
    want = [[1, "x", 2], [1, "y", 2]]
    assert calls == [0, 1, 1] and sorted(s.collect({"out": s.snapshot("out")})["out"]) == want
    again = StreamSession.restore(spark, PROGRAM, ["out"], str(tmp_path / "state" / "b"))
    run(again, "other", lambda n, changes: calls.append("twice"))
    assert "twice" not in calls and sorted(again.collect({"out": again.snapshot("out")})["out"]) == want


def test_host_survives_a_failed_commit(spark, monkeypatch):
    host = Host(StreamSession(spark, PROGRAM, ["out"]), materialized=frozenset(["out"]))
    server = serve(host)
    try:
        collect = host.session.collect
        monkeypatch.setattr(host.session, "collect", lambda changes: (_ for _ in ()).throw(OSError("lost")))
        try:
            status = call(server, "/ingress/a", '{"insert": {"k": "x", "v": 1}}')[0]
        except OSError:  # the connection is dropped
            status = 500
        assert status >= 500 and host.session.pending is None and host.session.time == StreamSession(spark, PROGRAM, ["out"]).time
        monkeypatch.setattr(host.session, "collect", collect)
        assert call(server, "/ingress/a", '{"insert": {"k": "x", "v": 2}}')[0] == 200
        assert call(server, "/egress/out")[1][0]["json_data"] == [{"insert": {"key": "x", "value": 2}}]
    finally:
        server.shutdown()


T = record({"a": array(I64), "b": BYTES, "d": DATE, "f": F64, "i": INTERVAL, "j": JSON, "m": dict_of(I64, STRING), "o": optional(STRING), "t": TIME, "ts": TIMESTAMP})
ROW = {"a": [1, 2], "b": {"base64": "aGk="}, "d": "2024-01-15", "f": 1.5, "i": "P1DT2H", "j": {"z": [1, 1.0], "a": None}, "m": {"2": "x", "10": "y"}, "o": None, "t": "14:30:00.5", "ts": "2024-01-15 14:30:00"}


def test_rows_round_trip(spark):
    program = "t :: zset(record(a: array(i64), b: bytes, d: date, f: f64, i: interval, j: json, m: dict(i64, string), o: optional(string), t: time, ts: timestamp))\nt := input(\"t\")\nout := map(t, function((r) -> r))"
    s = StreamSession(spark, program, ["out"])
    assert s.collect(s.step({"t": s.rows("t", [(1, ROW)])})) == {"out": [[1, ROW]]}


@pytest.mark.parametrize("change", [{"a": ["x"]}, {"d": "2024-1-5"}, {"f": True}, {"i": "P1M"}, {"zz": 1}, {"m": {"x": "y"}}, {"b": "aGk="}, {"a": None}])
def test_bad_rows(change):
    with pytest.raises((codec.BadRow, ValueError)):
        codec.decode_row(T, ROW | change)


def test_command_line(tmp_path, capsys):
    good, bad = tmp_path / "g", tmp_path / "b"
    good.write_text(PROGRAM)
    bad.write_text("out(a: x) <- nope(a: x)\n")
    assert main(["validate", "--streams", str(good)]) == 0 and main(["validate", str(bad)]) == 1
    assert "unknown relation" in capsys.readouterr().err
