"""An HTTP face of the registry, by the standard library alone: JSON in and out, one thread a request."""

from __future__ import annotations

import base64
import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .operators.rules import Rule, RuleError
from .plans.answer import RateLimited, Unavailable
from .plans.graph import GraphError
from .plans.shaping import json_safe
from .session import Registry, SessionError, StateError
from .sources.upload import TYPES


class HttpError(Exception):
    def __init__(self, status: int, detail: str) -> None:
        super().__init__(detail)
        self.status, self.detail = status, detail


def _report(r) -> dict:
    return {"tables": r.tables, "errors": r.errors, "notes": r.notes, "lost_links": r.lost_links, "changes": r.ledger.total, "ledger": [vars(x) for x in r.ledger.records], "flags": [vars(f) for f in r.flags]}


def _contract(c) -> dict:
    return {"tables": {t: {n: vars(x) for n, x in tc.columns.items()} for t, tc in c.tables.items()}, "links": [vars(e) for e in c.graph.edges]}


def handle(registry: Registry, method: str, path: str, body: dict) -> tuple[int, dict]:
    """One request: (status, reply). Routes: session, upload, apply-rules, resolve-duplicates, schema, confirm-schema, ask, metrics, health."""
    try:
        return 200, _routed(registry, method, path, body)
    except HttpError as e:
        return e.status, {"detail": e.detail}
    except SessionError:
        return 404, {"detail": "there is no such session"}
    except StateError as e:
        return 409, {"detail": str(e)}
    except (RuleError, GraphError, KeyError) as e:
        return 400, {"detail": str(e)}
    except RateLimited as e:
        return 429, {"detail": str(e)}
    except Unavailable as e:
        return 502, {"detail": str(e)}


def _routed(registry: Registry, method: str, path: str, body: dict) -> dict:
    route = (method, path.strip("/").split("/")[0])
    if route == ("GET", "health"):
        return {"status": "ok"}
    if route == ("GET", "metrics"):
        return dict(registry.report())
    if route == ("POST", "session"):
        return {"session_id": registry.create().id}
    if method == "DELETE" and (m := re.fullmatch(r"/?session/([\w-]+)", path)):
        return {"ended": registry.end(m[1])}
    w = registry.get(str(body.get("session_id", "")))
    if route == ("POST", "upload"):
        files = [(f["name"], base64.b64decode(f["data"])) for f in body.get("files", [])]
        bad = [n for n, _ in files if not n.lower().endswith(TYPES)]
        if bad:
            raise HttpError(415, f"files of this type aren't read: {', '.join(bad)}")
        r = w.upload(files)
        if r.errors and not r.tables:
            raise HttpError(422, "; ".join(f"{n}: {e}" for n, e in r.errors.items()))
        return _report(r)
    if route == ("POST", "apply-rules"):
        return _report(w.apply_rules([Rule(**x) for x in body.get("rules", [])]))
    if route == ("POST", "resolve-duplicates"):
        return {"removed": w.resolve(body["table"], body.get("groups", []), body.get("action", "remove"))}
    if route in (("GET", "schema"), ("POST", "schema")):
        return _contract(w.schema())
    if route == ("POST", "confirm-schema"):
        return _contract(w.confirm(edits=body.get("edits", []), dictionary=body.get("dictionary"), links=[tuple(x) for x in body.get("links", [])], manual=[tuple(x) for x in body.get("manual", [])]))
    if route == ("POST", "ask"):
        return w.ask(body["question"]).as_dict()
    raise HttpError(404, "there is no such route")


def serve(registry: Registry, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                status, out = handle(registry, self.command, self.path, body)
            except json.JSONDecodeError:
                status, out = 400, {"detail": "the body is no JSON"}
            data = json.dumps(json_safe(out), default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
