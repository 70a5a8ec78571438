"""A small HTTP host: one program, its tables and views, transactions and tokens.

Rows go in as newline-separated JSON changes or as an array; a request is a
transaction unless one is open.  Good rows are taken even if others are refused,
and the answer then is 400 with how many were.  A view answers with the chunks of
its changes since a sequence number, or with its snapshot.
"""

from __future__ import annotations

import base64
import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from ..sources import codec
from ..types import record
from .session import StreamSession

#: Most chunks that are kept for a view; older ones are dropped and leave a gap in the numbers.
QUEUE = 100


class Host:
    """Serialises requests to a session."""

    def __init__(self, session: StreamSession, *, form: str = "insert_delete", materialized: frozenset[str] = frozenset()):
        self.session, self.form, self.materialized = session, form, materialized
        self.lock, self.incarnation = threading.Lock(), uuid.uuid4().hex
        self.running, self.open = True, False
        self.chunks: dict[str, list[dict]] = {n: [] for n in session.outputs}
        self.numbers = dict.fromkeys(session.outputs, 0)
        self.steps, self.records = 0, 0
        self.waiting: list[tuple[str, object]] = []

    def token(self) -> str:
        return base64.urlsafe_b64encode(json.dumps({"u": self.incarnation, "e": "in", "c": self.steps + (self.open or not self.running)}).encode()).decode()

    def completed(self, token: str) -> bool:
        t = json.loads(base64.urlsafe_b64decode(token))
        if t["u"] != self.incarnation:
            raise codec.BadRow("the token is of another run")
        return self.steps >= t["c"]

    def ingress(self, table: str, lines: list[object], partition: int = 0) -> tuple[int, dict]:
        good, errors = [], []
        for k, line in enumerate(lines):
            try:
                change = codec.read_change(self.form, line)
                codec.decode_row(self._given(table), change[1])
                good.append(change)
            except (codec.BadRow, TypeError, AttributeError) as e:
                errors.append({"index": k, "message": str(e)})
        with self.lock:
            if good:
                self.records += len(good)
                self.waiting.append((table, self.session.rows(table, good, partition=partition)))
                self._advance()
        if errors:
            return 400, {"error_code": "ParseErrors", "message": f"{len(errors)} rows were refused", "details": errors}
        return 200, {"token": self.token()}

    def _given(self, table: str):
        t, part, off = self.session._columns(table)
        return record({n: x for n, x in t.fields if n not in (part, off)})

    def _advance(self) -> None:
        if not self.running or self.open or not self.waiting:
            return
        before = self.session.state()
        try:
            self.session.begin()
            for table, df in self.waiting:
                self.session.push(table, df)
            changes = self.session.collect(self.session.commit())
        except Exception:  # the rows wait for the next transaction, which the session is free for
            self.session.reset(before)
            raise
        self.waiting = []
        self.steps += 1
        for name, rows in changes.items():
            if rows:
                data = [c for w, *row in rows for c in codec.write_change(self.form, w, row[0] if len(row) == 1 else {"key": row[0], "value": row[1]})]
                self.chunks[name] = [*self.chunks[name], {"sequence_number": self.numbers[name], "snapshot": False, "json_data": data}][-QUEUE:]
                self.numbers[name] += 1

    def handle(self, method: str, path: str, query: dict[str, str], body: str) -> tuple[int, object]:
        parts = [p for p in path.split("/") if p]
        match (method, parts):
            case ("POST", ["ingress", table]):
                if table not in self.session.graph.tables:
                    return 404, {"error_code": "UnknownInputStream", "message": f"no table `{table}`"}
                try:
                    lines = json.loads(body) if query.get("array") == "true" else [json.loads(x) for x in body.splitlines() if x.strip()]
                except ValueError as e:
                    return 400, {"error_code": "ParseErrors", "message": str(e)}
                return self.ingress(table, lines, int(query.get("partition", 0)))
            case ("POST", ["egress", view]):
                if view not in self.chunks:
                    return 404, {"error_code": "UnknownOutputStream", "message": f"no view `{view}`"}
                if query.get("snapshot") == "true":
                    if view not in self.materialized:
                        return 400, {"error_code": "NotMaterialized", "message": f"`{view}` is not materialized"}
                    with self.lock:
                        rows = self.session.collect({view: self.session.snapshot(view)})[view]
                    return 200, [{"sequence_number": self.numbers[view], "snapshot": True, "json_data": [{"weight": w, "data": r[0] if len(r) == 1 else {"key": r[0], "value": r[1]}} for w, *r in rows]}]
                return 200, [c for c in self.chunks[view] if c["sequence_number"] >= int(query.get("from", 0))]
            case ("GET", ["completion_status"]):
                try:
                    return 200, {"status": "complete" if self.completed(query["token"]) else "inprogress"}
                except (codec.BadRow, ValueError, KeyError) as e:
                    return 410, {"error_code": "InvalidToken", "message": str(e)}
            case ("GET" | "POST", ["start" | "pause" as what]):
                with self.lock:
                    self.running = what == "start"
                    self._advance()
                return 200, {"state": "Running" if self.running else "Paused"}
            case ("POST", ["start_transaction"]):
                if self.open:
                    return 409, {"error_code": "TransactionInProgress", "message": "a transaction is open"}
                self.open = True
                return 200, {"transaction_id": self.steps + 1}
            case ("POST", ["commit_transaction"]):
                if not self.open:
                    return 409, {"error_code": "NoTransactionInProgress", "message": "no transaction is open"}
                with self.lock:
                    self.open = False
                    self._advance()
                return 200, {"token": self.token()}
            case ("GET", ["stats"]):
                return 200, {"state": "Running" if self.running else "Paused", "total_processed_records": self.records, "steps": self.steps, "buffered": len(self.waiting)}
            case ("GET", ["metadata"]):
                graph = self.session.graph
                return 200, {"tables": {t: str(x) for t, x in graph.tables.items()}, "views": {n: str(graph.nodes[graph.names[n]].shape) for n in self.session.outputs}}
            case ("POST", ["checkpoint"]):
                with self.lock:
                    self.session.checkpoint(query["path"])
                return 200, {"checkpoint": query["path"]}
        return 404, {"error_code": "NotFound", "message": path}


def serve(host: Host, port: int = 0) -> ThreadingHTTPServer:
    """Listen on the local address in a thread; ``server_port`` of the result says where."""

    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            url = urlparse(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            status, answer = host.handle(self.command, url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, body)
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _run

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
