"""Route requests over HTTP, answered by the same batch code as the stream.

POST /dijkstra takes a GeoJSON collection (``streaming/requests.py``) of at most LIMIT
bytes and gives a GeoJSON feature; GET /metrics lists the graph's metrics; other GET paths
serve the files of a folder, if one is given.  Requests that come while a batch is being
answered wait and form the next batch, so load makes batches larger instead of jobs more.
"""

from __future__ import annotations

import itertools
import json
import queue
import threading
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

from .graph import Graph
from .operators.spatial import grid_bounds
from .streaming.requests import answer

#: Bytes of a request, and the routes below.
LIMIT = 1024
BATCH = 1000


class Batches:
    """Answers bodies in batches on a thread of its own."""

    def __init__(self, g: Graph, method: str):
        self.g, self.method, self.bounds = g, method, grid_bounds(g.nodes)
        self.waiting: queue.Queue = queue.Queue()
        self.ids = itertools.count()
        threading.Thread(target=self._run, daemon=True).start()

    def ask(self, body: str) -> tuple[int, str]:
        done: queue.Queue = queue.Queue()
        self.waiting.put((next(self.ids), body, done))
        return done.get()

    def _run(self) -> None:
        spark = self.g.edges.sparkSession
        while True:
            asked = [self.waiting.get()]
            while len(asked) < BATCH and not self.waiting.empty():
                asked.append(self.waiting.get())
            try:
                rows = spark.createDataFrame([(i, body) for i, body, _ in asked], "id long, body string")
                found = {r["id"]: (r["status"], r["body"]) for r in answer(rows, self.g, self.bounds, self.method).collect()}
            except Exception as e:  # one batch that fails must not end the service
                found = {i: (500, json.dumps({"error": type(e).__name__})) for i, _, _ in asked}
            for i, _, done in asked:
                done.put(found[i])


class Handler(SimpleHTTPRequestHandler):
    def __init__(self, *args, batches: Batches, folder: str | None, **more):
        self.batches, self.folder = batches, folder
        super().__init__(*args, directory=folder or ".", **more)

    def reply(self, status: int, body: str) -> None:
        raw = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_POST(self) -> None:
        if self.path != "/dijkstra":
            return self.reply(404, "{}")
        size = self.headers.get("Content-Length", "")
        if not size.isdigit():
            return self.reply(411, "{}")
        if int(size) > LIMIT:
            self.close_connection = True
            return self.reply(413, json.dumps({"error": f"a request has at most {LIMIT} bytes"}))
        return self.reply(*self.batches.ask(self.rfile.read(int(size)).decode("utf-8", "replace")))

    def do_GET(self) -> None:
        if self.path == "/metrics":
            return self.reply(200, json.dumps(list(self.batches.g.metrics)))
        return super().do_GET() if self.folder else self.reply(404, "{}")

    def log_message(self, *args) -> None:
        pass


def server(g: Graph, port: int = 8080, method: str = "prp", folder: str | None = None) -> ThreadingHTTPServer:
    """A server on the local host; ``serve_forever`` runs it."""
    return ThreadingHTTPServer(("localhost", port), partial(Handler, batches=Batches(g, method), folder=folder))
