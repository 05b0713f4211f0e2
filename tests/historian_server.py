"""A historian in memory, for tests: history by tag and range, both ends held, and values written now."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class Store:
    def __init__(self):
        self.points, self.written, self.asked, self.failing = [], [], [], 0
        self.lock = threading.Lock()


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        store: Store = self.server.store
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["data"]
        with store.lock:
            if store.failing:
                store.failing -= 1
                return self.answer(503, {"error": "busy"})
            if self.path.endswith("writeTagValues"):
                now = datetime.now().isoformat(sep=" ", timespec="seconds")
                store.written.append(body["values"])
                store.points += [(tag, now, v) for tag, v in body["values"].items()]
                return self.answer(200, {"isSuccess": True})
            store.asked.append((tuple(body["tagNames"]), body["begTime"], body["endTime"]))
            if "refused" in body["tagNames"]:
                return self.answer(200, {"isSuccess": False, "message": "unknown tag"})
            found = [{"tagName": g, "tagTime": t, "tagValue": v} for g, t, v in store.points if g.strip() in body["tagNames"] and not body["begTime"] > t[:19] and not t[:19] > body["endTime"]]
        self.answer(200, {"isSuccess": True, "content": {"records": found or None}})

    def answer(self, code, body):
        out = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *args):
        pass


def serve():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.store = Store()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"
