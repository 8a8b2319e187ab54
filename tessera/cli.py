"""python -m tessera.cli --thesis FILE --root FOLDER [--limit N] [--source a,b] --landing FOLDER

Reads landed payloads (repos/*.json, posts/*.json, feeds/*.xml), runs the
pipeline and prints the ranked companies.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tessera.plans import pipeline, serve
from tessera.plans.thesis import parse
from tessera.schemas import COMPANY, SOURCES
from tessera.session import session
from tessera.sources import mentions
from tessera.store import children, clear


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera", allow_abbrev=False)
    p.add_argument("--thesis", required=True)
    p.add_argument("--root", required=True)
    p.add_argument("--landing", required=True)
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--source", default=",".join(SOURCES))
    out, _ = p.parse_known_args(argv)  # unknown flags are ignored
    if out.limit <= 0:
        p.error("--limit must be positive")
    out.source = out.source.split(",")
    if wrong := [s for s in out.source if s not in SOURCES]:
        p.error(f"unknown source {', '.join(wrong)}")
    return out


def main(argv: list[str] | None = None) -> None:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = session()
    now = F.current_timestamp()
    every = {
        "github": lambda since: mentions.read_repos(spark, f"{args.landing}/repos", now, since, args.limit, searched=False),
        "hackernews": lambda since: mentions.read_posts(spark, f"{args.landing}/posts", now, int(since) if since else None, args.limit),
        "rss": lambda since: mentions.read_feeds(spark, children(spark, f"{args.landing}/feeds"), now, since, args.limit, lambda feed, error: print(f"feed {feed}: {error}", file=sys.stderr)),
    }
    thesis = parse(Path(args.thesis).read_text(encoding="utf-8"))
    result = pipeline.run(spark, args.root, thesis, {s: every[s] for s in args.source}, now)
    deals = spark.read.parquet(f"{args.root}/deals").where(F.col("run_id") == result.run_id)
    names = pipeline.Store(spark, args.root).read("companies", COMPANY)
    for row in serve.ranked_text(deals, names).toLocalIterator():
        print(f"{row.line}\n   {row.rationale}")
    if result.failed:
        print(f"failed sources: {', '.join(result.failed)}")
    clear(spark)


if __name__ == "__main__":
    main()
