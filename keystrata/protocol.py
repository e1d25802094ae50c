"""The binary request protocol and its server and client, and the JSON bridge over HTTP.

Request: type, key length, value length (little-endian), key, value; SQL travels in the key, a scan's end in the value.
Response: status, length, payload.
"""

from __future__ import annotations

import json
import socket
import socketserver
import struct
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark import inheritable_thread_target

from keystrata.kv import InvalidArgument, KVStore
from keystrata.operators.log import MAX_KEY, MAX_VALUE
from keystrata.session import Session

#: Request types, statuses, default port.
PUT, GET, REMOVE, SCAN, SQL = 1, 2, 3, 4, 5
OK, NOT_FOUND, ERROR = 0, 1, 2
PORT = 7690


def request(kind: int, key: str = "", value: str = "") -> bytes:
    k, v = key.encode(), value.encode()
    return struct.pack("<BII", kind, len(k), len(v)) + k + v


def response(status: int, payload: bytes = b"") -> bytes:
    return struct.pack("<BI", status, len(payload)) + payload


def _strings(*texts: str) -> bytes:
    return b"".join(struct.pack("<I", len(b)) + b for b in (t.encode() for t in texts))


def _exactly(read, n: int) -> bytes | None:
    data = b""
    while len(data) < n:
        part = read(n - len(data))
        if not part:
            return None
        data += part
    return data


def answer(kind: int, key: str, value: str, store: KVStore, session: Session) -> bytes:
    try:
        if kind == PUT:
            store.put(key, value)
            return response(OK)
        if kind == GET:
            found = store.get(key)
            return response(NOT_FOUND) if found is None else response(OK, found.encode())
        if kind == REMOVE:
            store.remove(key)
            return response(OK)
        if kind == SCAN:
            rows = store.scan(key, value).collect()
            return response(OK, struct.pack("<I", len(rows)) + b"".join(_strings(r["k"], r["v"]) for r in rows))
        if kind == SQL:
            result = session.sql(key)
            return response(OK, result.to_wire()) if result.ok else response(ERROR, result.message.encode())
    except Exception as e:  # a request that fails must not end the connection
        return response(ERROR, str(e).encode("utf-8", "replace"))
    return response(ERROR, b"unknown request")


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        while head := _exactly(self.rfile.read, 9):
            kind, k, v = struct.unpack("<BII", head)
            if k > MAX_KEY or v > MAX_VALUE or (body := _exactly(self.rfile.read, k + v)) is None:
                return
            try:
                key, value = body[:k].decode(), body[k:].decode()
            except UnicodeDecodeError as e:
                self.wfile.write(response(ERROR, str(e).encode()))
                continue
            with self.server.lock:
                self.wfile.write(answer(kind, key, value, self.server.store, self.server.session))


class Server(socketserver.ThreadingTCPServer):
    """A thread for each client; statements run one at a time."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, store: KVStore, session: Session, host: str = "127.0.0.1", port: int = PORT):
        super().__init__((host, port), _Handler)
        self.store, self.session, self.lock = store, session, threading.Lock()

    def start(self) -> Server:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self


class Client:
    """Speaks the protocol; a context manager."""

    def __init__(self, host: str = "127.0.0.1", port: int = PORT, timeout: float = 60):
        self.socket = socket.create_connection((host, port), timeout)

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.socket.close()

    def _ask(self, kind: int, key: str, value: str = "") -> tuple[int, bytes]:
        self.socket.sendall(request(kind, key, value))
        head = _exactly(self.socket.recv, 5)
        if head is None:
            raise ConnectionError("the server closed the connection")
        status, n = struct.unpack("<BI", head)
        return status, _exactly(self.socket.recv, n) or b""

    def _well(self, *args: str) -> bytes | None:
        status, payload = self._ask(*args)
        if status == NOT_FOUND:
            return None
        if status != OK:
            raise InvalidArgument(payload.decode())
        return payload

    def put(self, key: str, value: str) -> None:
        self._well(PUT, key, value)

    def get(self, key: str) -> str | None:
        found = self._well(GET, key)
        return None if found is None else found.decode()

    def delete(self, key: str) -> None:
        self._well(REMOVE, key)

    def scan(self, first: str, last: str) -> list[tuple[str, str]]:
        read = _Reader(self._well(SCAN, first, last))
        return [(read.text(), read.text()) for _ in range(read.number())]

    def execute_sql(self, text: str) -> dict:
        """ok, message, columns, rows (texts)."""
        status, payload = self._ask(SQL, text)
        if status != OK:
            return {"ok": False, "message": payload.decode(), "columns": [], "rows": []}
        read = _Reader(payload)
        message = read.text()
        columns = [read.text() for _ in range(read.number())]
        return {"ok": True, "message": message, "columns": columns, "rows": [[read.text() for _ in columns] for _ in range(read.number())]}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        self.at += 4
        return struct.unpack_from("<I", self.data, self.at - 4)[0]

    def text(self) -> str:
        n = self.number()
        self.at += n
        return self.data[self.at - n : self.at].decode()


#: A workbench: a statement, its result as a table with the time taken, and the statements so far.
PAGE = """<!doctype html><meta charset="utf-8"><title>keystrata</title>
<style>body{font:14px sans-serif;margin:2em}textarea{width:100%;height:6em}td,th{border:1px solid #999;padding:2px 6px}li{cursor:pointer}</style>
<textarea id="sql">SHOW TABLES</textarea><p><button id="run">Run</button> <span id="say"></span></p><table id="out"></table><h4>History</h4><ol id="past"></ol>
<script>
const $ = id => document.getElementById(id), row = (cells, kind) => { const r = $("out").insertRow(); for (const c of cells) { const x = document.createElement(kind); x.textContent = c; r.append(x) } }
$("run").onclick = async () => {
  const sql = $("sql").value, began = performance.now()
  const r = await (await fetch("/api/sql", {method: "POST", body: JSON.stringify({sql})})).json()
  $("say").textContent = `${r.message} (${Math.round(performance.now() - began)} ms)`
  $("out").replaceChildren(); if (r.columns?.length) { row(r.columns, "th"); r.rows.forEach(c => row(c, "td")) }
  const li = document.createElement("li"); li.textContent = sql; li.onclick = () => { $("sql").value = sql }; $("past").prepend(li)
}
</script>"""


def http_server(session: Session, host: str = "127.0.0.1", port: int = 0, limit: float | None = None) -> ThreadingHTTPServer:
    """``POST /api/sql`` with {"sql": text}, ``GET /api/health``, and a page to type statements in at ``/``; not started.

    ``limit``: seconds after which a statement is answered as failed; its jobs are cancelled.
    """
    lock = threading.Lock()

    def limited(text: str) -> str:
        """The result as JSON."""
        if limit is None:
            return session.sql(text).to_json()
        context, group = session.spark.sparkContext, f"http-{uuid.uuid4().hex}"

        def run() -> str:
            context.setJobGroup(group, text)
            return session.sql(text).to_json()

        with ThreadPoolExecutor(1) as pool:
            made = pool.submit(inheritable_thread_target(session.spark)(run))
            try:
                return made.result(limit)
            except TimeoutError:
                context.cancelJobGroup(group)
                raise TimeoutError("Connection to the server timed out") from None

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: str = "", kind: str = "application/json") -> None:
            self.send_response(code)
            for name, value in (("Content-Type", kind), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "Content-Type"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Content-Length", str(len(body.encode())))):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body.encode())

        def do_OPTIONS(self) -> None:
            self._send(204)

        def do_GET(self) -> None:
            if self.path == "/api/health":
                with lock:
                    ok = session.sql("SHOW TABLES").ok
                self._send(200, json.dumps({"ok": ok, "status": "connected" if ok else "disconnected"}))
            elif self.path == "/":
                self._send(200, PAGE, "text/html; charset=utf-8")
            else:
                self._send(404, json.dumps({"ok": False, "message": "Not found"}))

        def do_POST(self) -> None:
            if self.path != "/api/sql":
                return self._send(404, json.dumps({"ok": False, "message": "Not found"}))
            try:
                text = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))).get("sql")
            except (ValueError, AttributeError):
                text = None
            if not isinstance(text, str) or not text:
                return self._send(400, json.dumps({"ok": False, "message": "Missing \"sql\" field"}))
            try:
                with lock:
                    self._send(200, limited(text))
            except Exception as e:  # the bridge answers whatever happens
                self._send(500, json.dumps({"ok": False, "message": str(e), "columns": [], "rows": []}))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
