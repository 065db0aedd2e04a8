"""URL filter rules, indexed by their rarest literal token, on DataFrame functions only.

Host rules and pattern rules are one table. Each rule stands under one literal
token that any url it fits must contain; of its tokens, the one that the fewest
rules share. A url's distinct tokens fetch candidate rules from hashed buckets,
and only those candidates' regular expressions run. The index is a constant in the
plan, so judging needs neither a join nor a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The host rules of the query: verdict, host, path. Fixed values.
HOST_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Pattern rules that decide where no host rule fits: words that stand alone in host or path. Fixed values.
BLOCKED_WORDS = ["casino", "porn", "xxx", "viagra", "warez", "torrent", "malware", "phishing", "doubleclick", "adserver"]
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``rule`` is the host rule's text, or None for a pattern; ``tokens`` must all be in a url that fits."""

    verdict: str
    rule: str | None
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains if the url's path starts with the rule's."""
    host = host.translate(str.maketrans(UPPER, LOWER))
    whole = re.findall(r"[a-z0-9]+", host)
    steps = [t.lower() for t in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]  # a last word may go on in the url
    quoted = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", host), re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", path)
    return Rule(verdict, host + path, rf"(?s)^(?:[^/?#]*\.)?{quoted[0]}{quoted[1]}" if path else rf"(?s)^(?:[^/?#]*\.)?{quoted[0]}(?:/|$)", tuple(whole + steps))


def word_rule(verdict: str, word: str) -> Rule:
    return Rule(verdict, None, rf"(?i)(?:^|[^a-z0-9]){word}(?:$|[^a-z0-9])", (word,))


def rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [word_rule("block", w) for w in BLOCKED_WORDS]


def index(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules under the token of theirs that fewest rules share; the longer, then the first in order, on a tie."""
    shared = Counter(t for r in rules for t in set(r.tokens))
    out: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.tokens:
            raise ValueError(f"a rule needs a literal token: {r.pattern}")
        out.setdefault(min(set(r.tokens), key=lambda t: (shared[t], -len(t), t)), []).append(r)
    return out


def _literal(rules: list[Rule]) -> tuple[Column, int]:
    """The index as a constant: an array of buckets, each an array of entries."""
    found = index(rules)
    n = max(1, len(found))
    buckets: list[list[Column]] = [[] for _ in range(n)]
    for token, those in sorted(found.items()):
        for r in those:
            name = F.lit(r.rule) if r.rule is not None else F.lit(None).cast("string")
            entry = F.struct(F.lit(token).alias("token"), F.lit(r.pattern).alias("pattern"), name.alias("rule"), F.lit(r.verdict).alias("verdict"))
            buckets[zlib.crc32(token.encode()) % n].append(entry)
    none = F.array().cast("array<struct<token:string,pattern:string,rule:string,verdict:string>>")
    return F.array(*(F.array(*b) if b else none for b in buckets)), n


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def judge(pages: DataFrame, rule_list: list[Rule] | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    The longest host rule that fits decides; without one, a pattern that fits
    blocks, and else the url is allowed. Null urls have no host and no path and
    are allowed. Repeated rows give repeated results, an empty table an empty one. Other columns are ignored.
    """
    known, n = _literal(rules() if rule_list is None else rule_list)
    host, path = split(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # one projection per step, so that no step repeats the work of the one before
    rows = rows.withColumn("place", F.concat("host", "path"))
    rows = rows.withColumn("tokens", F.array_distinct(F.filter(F.split(F.translate("place", UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != "")))
    bucket = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(n)).cast("int")
    fetched = F.flatten(F.transform("tokens", lambda t: F.filter(F.get(known, bucket(t)), lambda e: e["token"] == t)))
    rows = rows.withColumn("candidates", fetched)
    rows = rows.withColumn("fits", F.filter("candidates", lambda e: F.rlike("place", e["pattern"])))
    host_fits = F.filter("fits", lambda e: e["rule"].isNotNull())
    longest = F.array_max(F.transform(host_fits, lambda e: F.struct(F.length(e["rule"]).alias("n"), e["rule"].alias("rule"), e["verdict"].alias("verdict"))))
    rows = rows.withColumn("chosen", longest)
    pattern = F.when(F.exists("fits", lambda e: e["verdict"] == "block"), "block").when(F.size("fits") > 0, "allow").otherwise(DEFAULT)
    return rows.select("page_id", "host", "path", F.col("chosen.rule").alias("rule"), F.coalesce("chosen.verdict", pattern).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"))


def oracle_sql() -> str:
    """The same verdicts in DuckDB, every rule tried on every url."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)
    words = "|".join(BLOCKED_WORDS)
    return rf"""
WITH parts AS (
    SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM parts
), rules(verdict, rhost, rpath) AS (VALUES {values}),
fits AS (
    SELECT s.page_id, s.host, s.path, max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := verdict)) AS best
    FROM split s JOIN rules ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
    GROUP BY ALL
)
SELECT s.page_id, s.host, s.path, f.best.rule AS rule,
       coalesce(f.best.verdict, CASE WHEN regexp_matches(s.host || s.path, '(?i)(^|[^a-z0-9])({words})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.host = s.host AND f.path = s.path
"""
