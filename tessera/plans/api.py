"""The engine's HTTP routes as one callable, and a small server for it.

``Api(...).handle(method, path, params, body)`` gives (status, answer); failures have the shape
{"error": {"code", "message"}}.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import serve
from tessera.plans.pipeline import Store
from tessera.schemas import COMPANY, DEAL, MEMBERS, RECORD, RUN, struct
from tessera.sources import stores
from tessera.store import children


def not_found(message: str) -> serve.RequestError:
    return serve.RequestError(404, "not_found", message)


def one(rows: DataFrame) -> dict | None:
    found = rows.limit(1).toJSON().collect()
    return json.loads(found[0]) if found else None


class Api:
    """trigger: starts a run with a thesis path and a limit (either may be None) under the id it is given."""

    def __init__(self, spark: SparkSession, root: str, trigger: Callable[[str, str | None, int | None], None]):
        self.spark, self.store, self.trigger = spark, Store(spark, root), trigger

    def deals(self) -> DataFrame:
        path = f"{self.store.root}/deals"
        return self.spark.read.schema(DEAL).parquet(path) if children(self.spark, path) else self.spark.createDataFrame([], struct(DEAL))

    def companies(self) -> DataFrame:
        return self.store.read("companies", COMPANY)

    def handle(self, method: str, path: str, params: dict[str, str] | None = None, body: str | None = None) -> tuple[int, object]:
        parts = [p for p in path.split("/") if p]
        try:
            match [method, *parts]:
                case ["GET", "health"]:
                    return 200, self.health()
                case ["GET", "deals"]:
                    return 200, serve.deal_page(self.deals(), self.companies(), self.store.read("runs", RUN), serve.DealQuery.parse(params or {}))
                case ["GET", "deals", company]:
                    return 200, self.deal(company)
                case ["GET", "companies", company, "provenance"]:
                    return 200, self.provenance(company)
                case ["POST", "runs"]:
                    return 202, self.start(body)
                case ["GET", "runs", run]:
                    return 200, self.run(run)
            raise not_found(f"no route {method} {path}")
        except serve.RequestError as e:
            return e.status, e.body
        except Exception:  # what went wrong is logged, not told
            import traceback

            traceback.print_exc()
            return 500, {"error": {"code": "internal_error", "message": "Internal server error"}}

    def health(self) -> dict:
        try:
            self.store.read("runs", RUN).limit(1).count()
        except Exception as e:
            raise serve.RequestError(500, "internal_error", f"store unreachable: {e}") from e
        return {"status": "ok"}

    def deal(self, company: str) -> dict:
        company = serve.check_company(company)
        run = stores.latest_run(self.store.read("runs", RUN)).first()
        if run is None:
            raise not_found(f"no completed run yet, so company {company} has no deal")
        detail = one(serve.deal_detail(self.deals(), self.companies(), self.store.read("members", MEMBERS), self.store.read("records", RECORD), run["id"], company))
        if detail is None:
            raise not_found(f"company {company} has no deal in the latest run {run['id']}")
        return {"runId": run["id"], **detail}

    def provenance(self, company: str) -> list[dict]:
        company = serve.check_company(company)
        rows = serve.company_provenance(self.companies(), self.store.read("members", MEMBERS), self.store.read("records", RECORD), company)
        return [json.loads(r) for r in rows.orderBy("field").toJSON().collect()]  # five rows

    def start(self, body: str | None) -> dict:
        try:
            asked = json.loads(body) if body else {}
        except ValueError:
            asked = {}
        thesis, limit = (asked.get(k) for k in ("thesisPath", "limitPerSource")) if isinstance(asked, dict) else (0, 0)
        if thesis is not None and (not isinstance(thesis, str) or not thesis):
            raise serve.invalid("thesisPath must be a text")
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0):
            raise serve.invalid("limitPerSource must be a positive number")
        run_id = str(uuid.uuid4())
        self.trigger(run_id, thesis, limit)
        return {"runId": run_id}

    def run(self, run: str) -> dict:
        run = serve.check_uuid(run)
        found = one(self.store.read("runs", RUN).where(F.col("id") == run))
        if found is None:
            raise not_found(f"no run {run}")
        return found


def server(api: Api, port: int) -> ThreadingHTTPServer:
    """A server of the routes; ``serve_forever()`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            url = urlsplit(self.path)
            size = int(self.headers.get("content-length") or 0)
            status, found = api.handle(self.command, url.path, dict(parse_qsl(url.query)), self.rfile.read(size).decode("utf-8") if size else None)
            raw = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
