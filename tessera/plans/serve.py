"""What clients read: ranked deals by keyset pages, details, provenance, printed ranks."""

from __future__ import annotations

import base64
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import resolve
from tessera.schemas import STAGES
from tessera.sources import stores
from tessera.store import table

MOST, USUAL = 100, 20


class RequestError(ValueError):
    """A request that cannot be served: status and code tell why."""

    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.body = status, {"error": {"code": code, "message": message}}


def invalid(message: str) -> RequestError:
    return RequestError(400, "validation_error", message)


def encode_cursor(score: float, company_id: str) -> str:
    text = json.dumps({"score": score, "companyId": company_id}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(token: str) -> tuple[float, str]:
    try:
        raw = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        score, company_id = raw["score"], raw["companyId"]
    except Exception as e:
        raise invalid("malformed cursor") from e
    if isinstance(score, bool) or not isinstance(score, (int, float)) or not isinstance(company_id, str):
        raise invalid("malformed cursor")
    return float(score), company_id


@dataclass(frozen=True)
class DealQuery:
    min_score: float | None = None
    sector: str | None = None
    stage: str | None = None
    limit: int = USUAL
    cursor: tuple[float, str] | None = None

    @classmethod
    def parse(cls, params: dict[str, str]) -> DealQuery:
        """From request parameters as texts."""
        try:
            low = float(params["minScore"]) if "minScore" in params else None
            limit = int(params.get("limit", USUAL))
        except ValueError as e:
            raise invalid("minScore and limit must be numbers") from e
        if low is not None and not 0 <= low <= 100:
            raise invalid("minScore must lie between 0 and 100")
        if not 1 <= limit <= MOST:
            raise invalid(f"limit must lie between 1 and {MOST}")
        if params.get("stage", STAGES[0]) not in STAGES:
            raise invalid("unknown stage")
        return cls(low, params.get("sector"), params.get("stage"), limit, decode_cursor(params["cursor"]) if "cursor" in params else None)


def list_deals(deals: DataFrame, companies: DataFrame, run_id: str, query: DealQuery) -> DataFrame:
    """One row more than a page, by score and then id; filters see the companies as they are now."""
    rows = deals.where(F.col("run_id") == run_id)
    if query.min_score is not None:
        rows = rows.where(F.col("score") >= query.min_score)
    if query.cursor:
        score, after = query.cursor
        rows = rows.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("company_id") > after)))
    own = companies.select(F.col("id").alias("company_id"), "canonical_name", "domain", "sector", "estimated_stage", "one_liner")
    if query.sector is not None:
        own = own.where(F.col("sector") == query.sector)
    if query.stage is not None:
        own = own.where(F.col("estimated_stage") == query.stage)
    return rows.join(own, "company_id").orderBy(F.desc("score"), "company_id").limit(query.limit + 1)


def deal_page(deals: DataFrame, companies: DataFrame, runs: DataFrame, query: DealQuery) -> dict:
    """A page of the latest run that can be ranked, with the cursor of the next."""
    run = stores.latest_run(runs).select("id").first()
    if run is None:
        return {"runId": None, "items": [], "cursor": None}
    rows = list_deals(deals, companies, run["id"], query).toJSON().collect()
    items = [json.loads(r) for r in rows[: query.limit]]
    more = len(rows) > query.limit
    return {"runId": run["id"], "items": items, "cursor": encode_cursor(items[-1]["score"], items[-1]["company_id"]) if more else None}


def check_uuid(value: str) -> str:
    try:
        return str(uuid.UUID(value))
    except ValueError as e:
        raise invalid("id must be a uuid") from e


def check_company(value: str) -> str:
    """A company id: that of its first record after "c-", or a uuid."""
    return value if re.fullmatch(r"c-[\w:.-]+", value) else check_uuid(value)


def deal_detail(deals: DataFrame, companies: DataFrame, members: DataFrame, records: DataFrame, run_id: str, company_id: str) -> DataFrame:
    """The deal, its company and its records in one row."""
    own = members.where(F.col("company_id") == company_id).join(records.withColumnRenamed("id", "source_record_id"), "source_record_id")
    listed = own.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("fetched_at", "source_record_id", "source", "source_id"))).alias("records"))
    deal = deals.where((F.col("run_id") == run_id) & (F.col("company_id") == company_id))
    return deal.join(companies.withColumnRenamed("id", "company_id").drop("flags"), "company_id").join(listed, "company_id", "left")


def ranked(deals: DataFrame) -> DataFrame:
    """``deals`` with their rank by score and then id.

    Rows are sorted by ranges of (score, id), so that even those of one score go to many tasks, and written with
    their places; the counts of the ranges before a row give the rest of its rank.
    """
    order = [F.desc("score"), F.asc("company_id")]
    placed = table(deals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_u", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_p", F.shiftright("_u", 33)).withColumn("_i", F.col("_u").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each range
    starts = placed.groupBy("_p").agg(F.count("*").alias("_t")).select("_p", (F.sum("_t").over(before) - F.col("_t")).alias("_s"))
    return placed.join(F.broadcast(starts), "_p").withColumn("rank", (F.col("_s") + F.col("_i") + 1).cast("int")).drop("_u", "_p", "_i", "_s")


def ranked_text(deals: DataFrame, companies: DataFrame) -> DataFrame:
    """(rank, line, rationale) as printed; a company without a row shows its id."""
    names = companies.select(F.col("id").alias("company_id"), "canonical_name")
    rows = ranked(deals).join(names, "company_id", "left")
    flags = F.when(F.size("flags") > 0, F.concat(F.lit(" ["), F.array_join("flags", ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("canonical_name", F.col("company_id").cast("string")), F.lit(" — score "), F.format_string("%.1f", F.col("score")), flags)
    return rows.select("rank", line.alias("line"), "rationale").orderBy("rank")


def company_provenance(companies: DataFrame, members: DataFrame, records: DataFrame, company_id: str) -> DataFrame:
    one = companies.where(F.col("id") == company_id)
    if one.limit(1).count() == 0:
        raise RequestError(404, "not_found", f"no company {company_id}")
    fields = ["name", "domain", "description"]
    own = members.where(F.col("company_id") == company_id).join(records.withColumnRenamed("id", "source_record_id"), "source_record_id")
    flat = own.select("company_id", F.col("source_record_id").alias("id"), "source", "fetched_at", *[F.col(f"extracted.{f}").alias(f) for f in fields])
    return resolve.provenance(one, flat)
