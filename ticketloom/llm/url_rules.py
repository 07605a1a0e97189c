"""URL filters: rules indexed by their rarest literal token, fetched by the tokens of each URL.

Native: DataFrame functions only. A rule is a regular expression over host and path with the literal
tokens that every match holds as whole tokens. It is indexed under the one of them that the fewest
URLs hold. A URL fetches the rules of its tokens and runs only their expressions. Rules without a
token are fetched by every URL.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    #: Of several fitting rules the longest wins, then the last name; ``named`` ones before patterns.
    length: int
    named: bool


def site_rule(site: str, action: str) -> Rule:
    """A rule like ``example.net/en/``: fits the host and its subdomains, and paths that begin so."""
    host, _, path = site.partition("/")
    literal = f"{host}/{path}"
    tokens = re.findall("[a-z0-9]+", literal.translate(str.maketrans(UPPER, LOWER)))
    if re.search("[A-Za-z0-9]$", literal):
        tokens = tokens[:-1]  # the path may go on within the token
    quoted = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", literal)
    return Rule(site, action, rf"^([^/]*\.)?{quoted}", tuple(dict.fromkeys(tokens)), len(literal), True)


def pattern_rule(name: str, action: str, pattern: str, *tokens: str) -> Rule:
    """A rule by regular expression over host and path; every match must hold the tokens as whole tokens."""
    return Rule(name, action, pattern, tokens, 0, False)


#: Sites of the production rules; fixed values.
SITES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Patterns that judge what no site rule fits; fixed values.
PATTERNS = [
    ("advert", "block", r"[./]ads[./]", "ads"),
    ("tracker", "block", r"[./]track(/|$)", "track"),
    ("login", "block", r"/login(/|$)", "login"),
    ("casino", "block", r"^([^/]*[.-])?casino[.-]", "casino"),
    ("calendar", "block", r"/calendar/[0-9]{4}/", "calendar"),
]


def production_rules() -> list[Rule]:
    return [site_rule(*x) for x in SITES] + [pattern_rule(*x) for x in PATTERNS]


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _tokens(address: str) -> Column:
    """Distinct tokens, lower case, and the empty one that fetches rules without a token."""
    parts = F.split(F.translate(F.col(address), UPPER, LOWER), "[^a-z0-9]+")
    return F.array_distinct(F.concat(parts, F.array(F.lit(""))))


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row.

    ``rule`` is the name of the winning site rule, or null; then the verdict is that of a fitting
    pattern (block before allow), or else the default. A null or empty URL, or one without ``://``,
    has empty host and path and gets the default. Repeated rows stay; other columns are ignored.
    Each different address is judged once, so a URL that many rows hold costs nothing more.
    """
    spark = pages.sparkSession
    host, path = host_path("url")
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    pages = pages.withColumn("address", F.concat("host", "path"))
    addresses = pages.select("address").distinct()
    exploded = addresses.select("address", F.explode(_tokens("address")).alias("token"))
    known = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if known:  # the rules are a list of the driver, and so are their tokens
        named = F.broadcast(spark.createDataFrame([(t,) for t in known], "token string"))
        counts = dict(exploded.join(named, "token").groupBy("token").count().collect())
    index = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), *r[:3], r.length, r.named) for r in rules]
    schema = "token string, name string, action string, pattern string, length int, named boolean"
    fetched = exploded.join(F.broadcast(spark.createDataFrame(index, schema)), "token")
    fitting = fetched.where(F.rlike("address", F.col("pattern")))
    rank = F.struct("named", "length", (F.col("action") == "block").alias("block"), "name", "action")
    best = fitting.groupBy("address").agg(F.max(rank).alias("best"))
    judged = pages.join(best, "address", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.named"), F.col("best.name")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
