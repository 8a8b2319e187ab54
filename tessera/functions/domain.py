"""Hosts and registrable domains of URLs.

Which suffixes are public is a parameter: the text of a public suffix list. Without
one a rule stands for it: the generic names below, every two-letter name (those of
countries), and the usual second levels below these.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Generic top-level names, and second levels under which countries register.
GENERIC_NAMES = (
    "com net org edu gov mil int info biz name pro mobi coop aero museum jobs travel tel cat asia post xxx arpa "
    "app dev page cloud tech software systems solutions digital online site website store shop blog news media studio design agency "
    "company ventures capital fund finance money bank insurance energy health care clinic bio science academy school university "
    "engineering network host space world global live life today xyz top club group team email chat games game video film music art photo "
    "email works work zone city land house estate build construction auto cars bike taxi express delivery kitchen restaurant cafe bar pizza coffee "
    "farm green eco earth security run tools codes legal law tax consulting services support expert guru institute foundation"
).split()
SECOND_LEVELS = "co com net org edu gov gob gouv mil ac or ne go nom ltd plc sch".split()

# Roots under which many unrelated projects are hosted.
GENERIC_HOSTS = ["github.io", "vercel.app", "notion.site", "herokuapp.com", "netlify.app"]


def host(url: Column) -> Column:
    """Lower-cased host of a URL, with or without a scheme; null where there is none."""
    rest = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^[^/?#\\]*", 0)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.nullif(bare, F.lit(""))


def generic(name: Column) -> Column:
    """Whether a host is one of the generic hosting roots or below one."""
    return name.rlike(r"(?:^|\.)(?:" + "|".join(g.replace(".", r"\.") for g in GENERIC_HOSTS) + r")$")


def safe_url(url: Column) -> Column:
    """The URL if its scheme is http or https, else null."""
    return F.when(url.rlike(r"(?i)^https?://[^/\s]+"), url)


def homepage_host(url: Column) -> Column:
    """The host of a homepage field; null if blank or without a dot."""
    found = host(url)
    return F.when(found.contains("."), found)


def suffix_rules(text: str) -> frozenset[str]:
    """The rules of a public suffix list."""
    return frozenset(x.split()[0] for x in text.splitlines() if x.strip() and not x.startswith("//"))


def read_suffix_rules(spark: SparkSession, path: str) -> frozenset[str]:
    """The rules of a list in any file system that Spark reads (about 10,000 short lines)."""
    return suffix_rules("\n".join(r[0] for r in spark.read.text(path).toLocalIterator()))


def registrable(name: str, rules: frozenset[str]) -> str | None:
    """The registrable domain of a host: one label more than its longest listed suffix."""
    labels = name.split(".")
    if len(labels) < 2 or not all(labels) or labels[-1].isdigit() or not all(set(x) <= _LABEL for x in labels):
        return None
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        if "!" + tail in rules:
            size = len(labels) - i - 1
        elif tail in rules or "*." + ".".join(labels[i + 1 :]) in rules and i + 1 < len(labels):
            size = len(labels) - i
        else:
            continue
        return ".".join(labels[-size - 1 :]) if len(labels) > size else None
    return None


_LABEL = set("abcdefghijklmnopqrstuvwxyz0123456789-_") | {chr(c) for c in range(0xA1, 0x3000)}


_SUFFIX = rf"(?:(?:{'|'.join(SECOND_LEVELS)})\.[a-z]{{2}}|[a-z]{{2}}|{'|'.join(dict.fromkeys(GENERIC_NAMES))})"
_LABELS = "[^.\\s]+"


def registrable_by_rule(name: Column) -> Column:
    """The registrable domain of a host by the names and levels above; null for a suffix itself, addresses and other names."""
    sound = name.rlike(rf"^(?:{_LABELS}\.)+{_SUFFIX}$") & ~name.rlike(f"^{_SUFFIX}$")
    return F.when(sound, F.regexp_extract(name, rf"(?:^|\.)({_LABELS}\.{_SUFFIX})$", 1))


def normalize_domain(url: Column, rules: frozenset[str] | None = None) -> Column:
    """The registrable domain; null for generic hosting, addresses, single labels and unlisted suffixes.

    The rules of a public suffix list, where given, travel with a function over Arrow batches; without them all is
    done in the JVM.
    """
    bare = F.regexp_replace(host(url), r"^www\.", "")
    named = F.when(~generic(bare), bare)
    if rules is None:
        return registrable_by_rule(named)

    @F.pandas_udf(StringType())
    def find(hosts: pd.Series) -> pd.Series:
        known = {h: registrable(h, rules) for h in hosts.dropna().unique()}
        return pd.Series([known.get(h) for h in hosts], dtype=object)

    return find(named)
