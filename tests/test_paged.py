"""The paged source against a local service."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from trailforge.adapters import langsmith
from trailforge.sources import paged

RUNS = {p: [{"id": f"{p}{i}", "run_type": "llm", "name": "n", "start_time": f"2024-01-01T00:00:{i:02d}Z"} for i in range(n)] for p, n in (("a", 7), ("b", 3), ("none", 0))}


@pytest.fixture
def service():
    asked, failures = Counter(), {"left": 2}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            project, token = query["project"], query.get("cursor")
            asked[project, token] += 1
            if failures["left"] and token == "a3":
                failures["left"] -= 1
                self.send_response(503)
                self.end_headers()
                return
            if project == "circle":
                body = {"data": {"runs": [{}]}, "next": {None: "x", "x": "y", "y": "x"}[token]}
            else:
                at = int(token[1:]) if token else 0
                body = {"data": {"runs": RUNS[project][at : at + 3]}, "next": f"{project}{at + 3}" if at + 3 < len(RUNS[project]) else None}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/runs", asked
    server.shutdown()


def options(url, *projects):
    return {"url": url, "chains": json.dumps({p: {"project": p} for p in projects}), "items": "data.runs", "wait": "0.01"}


def want(*projects):
    return sorted((p, i // 3, i, r["id"]) for p in projects for i, r in enumerate(RUNS[p]))


def given(rows):
    return sorted((r.file, r.page, r.pos, json.loads(r.record)["id"]) for r in rows)


def test_pages_in_a_batch(spark, service):
    paged.register(spark)
    url, _ = service
    rows = spark.read.format("paged_json").options(**options(url, "a", "b", "none")).load()
    assert rows.rdd.getNumPartitions() == 3
    assert given(rows.collect()) == want("a", "b", "none")
    found = langsmith.from_records(rows.drop("page"), rows.file)
    assert {r.scenario_id for r in found.collect()} == {"a", "b"}
    one = {**options(url), "chains": json.dumps({"a": {"project": "a", "token": "a3"}})}
    assert [json.loads(r.record)["id"] for r in spark.read.format("paged_json").options(**one).load().orderBy("pos").collect()] == ["a3", "a4", "a5", "a6"]
    with pytest.raises(Exception, match="circle"):
        spark.read.format("paged_json").options(**options(url, "circle")).load().collect()


def test_pages_in_a_stream_that_restarts(spark, service, tmp_path):
    paged.register(spark)
    url, asked = service

    def run(seconds):
        source = spark.readStream.format("paged_json").options(**options(url, "a", "b")).load()
        query = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable() if seconds is None else query.awaitTermination(seconds)
        query.stop()
        assert query.exception() is None

    run(6)
    first = given(spark.read.parquet(f"{tmp_path}/out").collect())
    assert first and set(first) <= set(want("a", "b")) and len(set(first)) == len(first)
    RUNS["b"].append({"id": "b3"})
    try:
        before = asked["a", None]
        run(6)
        assert given(spark.read.parquet(f"{tmp_path}/out").collect()) == want("a", "b")
        assert asked["a", None] == before  # the restart did not begin anew
    finally:
        RUNS["b"].pop()
