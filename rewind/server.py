"""The client over HTTP: one handler for each route, errors as status codes with their text."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from .client import Client
from .jobs import KINDS, BadJob
from .plans.preview import HasDependents, InvalidMode, NotFound

STATUS = ((HasDependents, 409), (NotFound, 404), (BadJob, 400), (InvalidMode, 400), (LookupError, 404))
COHORT = ("table", "fingerprint", "since", "until", "predicate")


def _selector(body: dict) -> dict:
    return {k: body.get(k) for k in COHORT}


def _job(client: Client, number: str) -> dict:
    job = client.queue.get(int(number))
    if job is None:
        raise NotFound(f"job {number} not found")
    return job | {"events": client.runner.events(job["id"])}


def _cancel(client: Client, number: str) -> dict:
    _job(client, number)
    return {"canceled": client.runner.cancel(int(number))}


def _track(client: Client, body: dict) -> dict:
    if not body.get("table"):
        raise BadJob("table is required")
    client.track(body["table"])
    return {"tracked": body["table"]}


#: (method, path pattern, handler of client, path groups, query or body).
ROUTES = [
    ("POST", r"/v1/init", lambda c, g, b: c.init() | c.init_capture()),
    ("POST", r"/v1/track", lambda c, g, b: _track(c, b)),
    ("POST", r"/v1/track-all", lambda c, g, b: {"tracked": c.track_all()}),
    ("GET", r"/v1/changes", lambda c, g, b: c.log(table=b.get("table"), since=b.get("since"), limit=int(b.get("limit") or 50), include_undo=b.get("include_undo") == "true")),
    ("GET", r"/v1/tx/(\d+)", lambda c, g, b: c.show(int(g[0]))),
    ("POST", r"/v1/undo/preview", lambda c, g, b: c.preview(int(b["txid"])).as_dict()),
    ("POST", r"/v1/undo", lambda c, g, b: c.undo(int(b["txid"]), b.get("mode") or "clean_only")),
    ("POST", r"/v1/cohort/preview", lambda c, g, b: c.preview_cohort(**_selector(b))),
    ("POST", r"/v1/cohort/undo", lambda c, g, b: c.undo_cohort(b.get("mode") or "clean_only", **_selector(b))),
    ("GET", r"/v1/markers", lambda c, g, b: c.markers()),
    ("POST", r"/v1/markers", lambda c, g, b: {"id": c.mark(b["label"])}),
    ("GET", r"/v1/status", lambda c, g, b: c.status()),
    ("POST", rf"/v1/storage/({'|'.join(KINDS)})", lambda c, g, b: {"job": c.runner.submit(g[0], b)}),
    ("GET", r"/v1/storage/backups", lambda c, g, b: [r.asDict() for r in c.snapshots.list().collect()]),
    ("GET", r"/v1/jobs", lambda c, g, b: c.queue.list(b.get("state", ""), b.get("kind", ""), int(b.get("limit") or 50))),
    ("GET", r"/v1/jobs/(\d+)", lambda c, g, b: _job(c, g[0])),
    ("POST", r"/v1/jobs/(\d+)/cancel", lambda c, g, b: _cancel(c, g[0])),
]


def answer(client: Client, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
    """(status, result) of a request."""
    url = urlsplit(target)
    try:
        given = dict(parse_qsl(url.query)) if method == "GET" else json.loads(body or b"{}")
        for verb, pattern, handler in ROUTES:
            if verb == method and (m := re.fullmatch(pattern, url.path)):
                return 200, handler(client, m.groups(), given)
        return 404, {"ok": False, "error": f"no route {method} {url.path}"}
    except Exception as e:  # noqa: BLE001 - every error is an answer
        missing = isinstance(e, KeyError)
        code = 400 if missing else next((code for kind, code in STATUS if isinstance(e, kind)), 500)
        return code, {"ok": False, "error": f"{e} is required" if missing else str(e)}


def serve(client: Client, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server, not yet started; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            status, result = answer(client, self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            text = json.dumps(result, default=str).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
