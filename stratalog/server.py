"""The engine over HTTP: JSON in and out, standard library only."""

from __future__ import annotations

import io
import json
import shutil
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO, NamedTuple

from stratalog import __version__, types
from stratalog.engine import Engine
from stratalog.errors import EngineError, InvalidArgument, NotFound
from stratalog.formatting import envelope, spooled_envelope


#: What a console may offer.
CAPABILITIES = {
    "supportedStatements": ["CREATE TABLE", "DROP TABLE", "SHOW TABLES", "DESCRIBE", "INSERT", "UPDATE", "DELETE", "SELECT", "EXPLAIN"],
    "supportedTypes": sorted(types.ALIASES),
    "supportedAggregations": ["AVG", "COUNT", "MAX", "MIN", "SUM", "and every aggregate of Spark SQL"],
    "supportedWhereOps": ["=", "<>", "!=", "<", ">", "<=", ">=", "AND", "OR", "NOT", "IN", "BETWEEN", "LIKE", "IS NULL", "EXISTS"],
    "features": ["keyed tables with atomic commits", "merge on read", "compaction", "key and range pruning", "streaming ingest", "joins, windows and subqueries"],
}


class Spooled(NamedTuple):
    """A finished answer in a file."""

    file: IO[bytes]


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, status: int, body: str) -> None:
            self._send_file(status, io.BytesIO(body.encode()))

        def _send_file(self, status: int, body: IO[bytes]) -> None:
            size = body.seek(0, io.SEEK_END)
            body.seek(0)
            self.send_response(status)
            for k, v in (("Content-Type", "application/json"), ("Content-Length", str(size)), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(k, v)
            self.end_headers()
            shutil.copyfileobj(body, self.wfile)

        def _answer(self, work) -> None:
            try:
                found = work()
                if isinstance(found, Spooled):
                    with found.file as f:
                        self._send_file(200, f)
                else:
                    self._send(200, envelope(found))
            except NotFound as e:
                self._send(404, envelope(error=e))
            except EngineError as e:
                self._send(400, envelope(error=e))
            except Exception as e:
                self._send(500, envelope(error=e))

        def _statement(self) -> str:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                raise InvalidArgument("the body is not JSON") from None
            text = body.get("sql") or body.get("query") if isinstance(body, dict) else None
            if not isinstance(text, str) or not text.strip():
                raise InvalidArgument("the body needs a field sql")
            return text

        def do_OPTIONS(self) -> None:  # noqa: N802
            self._send(204, "")

        def do_POST(self) -> None:  # noqa: N802
            def query():
                # changes are optimistic commits, so statements run side by side
                result = engine.execute(self._statement())
                if result.error:
                    raise result.error
                return Spooled(spooled_envelope(result))

            routes = {
                "/api/query": query,
                "/api/explain": lambda: {"plan": engine.explain(self._statement())},
                "/api/admin/flush": lambda: {"flushed": engine.flush()},
                "/api/admin/compact": lambda: {"compacted": engine.compact()},
                "/api/admin/compact/pause": lambda: {"paused": engine.pause() is None},
                "/api/admin/compact/resume": lambda: {"resumed": engine.resume() is None},
            }
            self._route(routes)

        def do_GET(self) -> None:  # noqa: N802
            parts = self.path.split("?")[0].strip("/").split("/")
            if parts[:2] == ["api", "tables"] and len(parts) == 3:
                return self._answer(lambda: engine.catalog.get(parts[2]).to_json())
            if parts[:2] == ["api", "tables"] and len(parts) == 4 and parts[3] == "describe":
                return self._answer(lambda: [r.asDict() for r in engine.catalog.describe(parts[2]).collect()])
            return self._route(
                {
                    "/api/tables": lambda: engine.catalog.names(),
                    "/api/status": engine.stats,
                    "/api/health": lambda: {"status": "ok", "uptime_seconds": int(time.time() - engine.started), "version": __version__, "engine": "stratalog"},
                    "/api/info": lambda: {"version": __version__, "engine": "stratalog"} | CAPABILITIES,
                }
            )

        def _route(self, routes: dict) -> None:
            work = routes.get(self.path.split("?")[0].rstrip("/"))
            if work is None:
                self._send(404, envelope(error=NotFound(f"no such endpoint {self.path}")))
            else:
                self._answer(work)

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server ready for ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(engine))
