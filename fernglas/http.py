"""The service over HTTP: /api/search, /api/similar/ID, /api/search/by-image, /api/photo/ID/full and /api/health, with status
codes for what goes wrong."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .operators.filters import FilterSpec
from .schema import API
from .service import NotFound, Sources, Unavailable
from .sources.readers import read_file

#: The status of each kind of error, and the most bytes of an upload.
STATUS = ((NotFound, 404), (FileNotFoundError, 404), (Unavailable, 503), (NotImplementedError, 501))
UPLOAD = 20 << 20


def respond(sources: Sources, method: str, target: str, body: bytes = b"") -> tuple[int, dict | str]:
    """Status and answer to a request: a dict, or the path of a file. Wrong parameters: 422; an upload that is no picture:
    400; unknown items, files and paths: 404; no corpus: 503; a picture for an encoder of texts: 501."""
    parts = urlsplit(target)
    given = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    if not parts.path.startswith(f"{API}/"):
        return 404, {"detail": "not found"}
    steps = [unquote(s) for s in parts.path.removeprefix(API).split("/") if s]
    try:
        service = sources.get(given.get("source"))
        number = lambda name, kind: kind(given[name]) if name in given else None
        spec = FilterSpec(number("aperture_max", float), number("iso_max", int), number("focal_min", float), number("focal_max", float), given.get("camera_make"))
        k = int(given.get("k", 12))
        if (method, steps) == ("GET", ["health"]):
            return 200, {**service.health(), "sources": sorted(sources.services)}
        if (method, steps) == ("GET", ["search"]):
            return 200, service.search(given.get("q", ""), k, spec)
        if method == "GET" and len(steps) == 2 and steps[0] == "similar":
            return 200, service.similar(steps[1], k, spec)
        if method == "GET" and len(steps) == 3 and steps[0] == "photo" and steps[2] in ("full", "thumb"):
            return 200, service.file_path(steps[1])
        if (method, steps) == ("POST", ["search", "by-image"]):
            if len(body) > UPLOAD:
                return 413, {"detail": "the upload is too large"}
            return 200, service.search_by_image(given.get("name", "upload"), body, k, spec)
        return 404, {"detail": "not found"}
    except tuple(kind for kind, _ in STATUS) as e:
        return next(code for kind, code in STATUS if isinstance(e, kind)), {"detail": str(e)}
    except ValueError as e:
        return 400 if steps == ["search", "by-image"] and "image" in str(e) else 422, {"detail": str(e)}


def server(sources: Sources, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is not started yet."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            code, answer = respond(sources, method, self.path, self.rfile.read(min(length, UPLOAD + 1)))
            if isinstance(answer, str):
                data, kind = read_file(answer), "application/octet-stream"
            else:
                data, kind = json.dumps(answer).encode(), "application/json"
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
