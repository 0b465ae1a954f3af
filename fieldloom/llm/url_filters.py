"""URL filters: pattern rules indexed by their rarest literal token, in built-in expressions only.

A rule is a host and path prefix (``example.com/en/``: that host and all its subdomains, any path that
starts so) or a wildcard pattern (``||ads.example^``, ``/banner/*/img^``): ``*`` is any run, ``^`` a
separator or the end, ``||`` a host start, ``|`` an end of the address. Each rule is filed under the one of its literal
tokens that the fewest addresses hold. Tokens of an address fetch candidate rules by an equi-join; only
those run their regular expressions. A rule without a whole literal token is filed under the empty token,
which every address carries.

Edge cases: an address that is null or has no ``://`` has empty host and path and the default verdict;
repeated rows stay; columns named like results are replaced; an empty table gives an empty result, and without rules every
address gets the default; of rules that tie in length the last by name wins; addresses may be of any length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import BROADCAST_ROWS, Scratch, literal_table, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Splits an address into host and path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


def _host_rule(rule: str) -> tuple[str, list[str]]:
    h, slash, p = rule.partition("/")
    h, p = h.lower(), slash + p
    whole = p if not p or not p[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", p)  # a cut last word is no whole token
    end = "" if p else r"(?:/.*)?$"
    return rf"(?s)^(?:[^/]*\.)?{_literal(h)}{_literal(p)}{end}", _tokens(f"{h} {whole}")


def _pattern_rule(rule: str) -> tuple[str, list[str]]:
    body, start, end = rule, "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    regex = "".join(".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|$)" if c == "^" else _literal(c) for c in body)
    fenced = ("^" if start else "*") + body + ("^" if end else "*")
    return f"(?s){start}{regex}{end}", _tokens(" ".join(re.findall(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", fenced)))


def _tokens(text: str) -> list[str]:
    return sorted({t for t in re.split(r"[^a-z0-9]+", text.lower()) if t})


def compile_rules(spark: SparkSession, site_rules: list[tuple[str, str]], pattern_rules: list[tuple[str, str]] = ()) -> DataFrame:
    """Table (rule, verdict, regex, tokens, site, weight) of rules given as (rule, verdict). Site rules go before patterns, longer before shorter."""
    rows = []
    for rule, verdict in site_rules:
        rows.append((rule, verdict, *_host_rule(rule), True, len(rule)))
    for rule, verdict in pattern_rules:
        rows.append((rule, verdict, *_pattern_rule(rule), False, len(rule)))
    return literal_table(spark, rows, ["rule", "verdict", "regex", "tokens", "site", "weight"], ["string", "string", "string", "array<string>", "boolean", "int"])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", scratch: Scratch | None = None) -> DataFrame:
    """pages with host, path, rule (that of the site rule which decided, else null), pattern (likewise) and verdict.

    Addresses are judged once each, so repeated addresses cost one row; the verdicts join back by address,
    from a table in the shared folder, so that AQE can split a hot address.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    size = rules.agg(F.coalesce(F.sum(F.greatest(F.size("tokens"), F.lit(1))), F.lit(0))).first()[0]  # tokens, of which a rule has at least one row
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_ROWS else (lambda df: df)
    urls = pages.select(F.col(url).alias("_u")).where(F.col("_u").contains("://")).distinct()
    urls = urls.withColumn("_t", F.concat(host(F.col("_u")), path(F.col("_u"))))
    tokens = urls.select("_u", "_t", F.explode(F.array_distinct(F.concat(F.split(F.lower("_t"), "[^a-z0-9]+"), F.array(F.lit(""))))).alias("_k"))

    known = rules.select(F.explode("tokens").alias("_k")).distinct()
    seen = tokens.join(small(known), "_k", "left_semi").groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    filed = rules.withColumn("_k", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    index = (
        filed.join(seen, "_k", "left")
        .groupBy("rule", "verdict", "regex", "site", "weight")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_k"))).alias("_m"))
        .select("rule", "verdict", "regex", "site", "weight", F.col("_m._k").alias("_k"))
    )
    index = scratch.table(index, "url_index")
    best = (
        tokens.join(small(index), "_k")
        .where(F.expr("_t rlike regex"))
        .groupBy("_u")
        .agg(F.max(F.struct("site", "weight", "rule", "verdict")).alias("_b"))
    )
    best = scratch.table(best, "url_verdicts")
    out = without(pages, "host", "path", "rule", "pattern", "verdict")
    joined = out.join(best, F.col(url) == F.col("_u"), "left")
    return joined.select(
        *[joined[c] for c in out.columns],
        host(F.col(url)).alias("host"),
        path(F.col(url)).alias("path"),
        F.when(F.col("_b.site"), F.col("_b.rule")).alias("rule"),
        F.when(~F.col("_b.site"), F.col("_b.rule")).alias("pattern"),
        F.coalesce("_b.verdict", F.lit(default)).alias("verdict"),
    )
