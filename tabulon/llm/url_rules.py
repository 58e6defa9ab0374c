"""URL verdicts by hash-prefix lookup (built-in functions only).

Every URL is expanded into (host suffix, path prefix) expressions; every rule
is one such expression.  Both sides are digested.  The join is an equi-join on
the first ``PREFIX_HEX`` hex digits of the digest, and a candidate counts only
if the full digests are equal, so a shared short prefix never gives a match.
Of the rules that fit a URL the longest wins (host plus path; then the longer
host; then ``block``; then the smaller rule text).

Only path prefixes whose length occurs in a rule are expanded: a longer or
shorter prefix cannot equal a rule.  The expanded (page, expression) rows are
keyed by the short prefix; all pages expand to a few hot expressions such as
``com/``, so the join is left to Spark: a small rule table is broadcast by
measured size (``spark.sql.autoBroadcastJoinThreshold``), a larger one is
shuffled and adaptive execution splits the hot keys.  Expressions are first
reduced to one row per distinct URL key, so repeated URLs cost one lookup.

Defined results: a null URL or one without ``://`` has empty host and path and
gets the default verdict; an empty rule table gives the default verdict to all;
rules with a null host, path or action are ignored; repeated rules count once;
repeated pages each give a row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import ascii_lower, no_clash

#: hex digits of the digest that form the join key (32 bits)
PREFIX_HEX = 8
#: what a URL gets that fits no rule
DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``; then up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def with_parts(df: DataFrame) -> DataFrame:
    """host and path of the URLs in ``_u``."""
    d = df.withColumn("_u", F.coalesce(F.col("_u").cast("string"), F.lit("")))
    host, path = url_parts(F.col("_u"))
    return d.withColumns({"host": host, "path": path}).drop("_u")


def _expression(host: Column, path: Column) -> Column:
    # NUL cannot be part of a host, so host and path cannot run into each other
    return F.concat(host, F.lit("\u0000"), path)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with their digests, one row per expression."""
    r = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"),
                     F.lower("action").alias("r_action")).dropna()
    # the same expression named twice: block wins
    r = r.groupBy("r_host", "r_path").agg(F.max("r_action").alias("r_action"))
    return r.select(
        "*", F.concat("r_host", "r_path").alias("r_rule"),
        _digest(_expression(F.col("r_host"), F.col("r_path"))).alias("r_digest"),
    ).withColumn("r_key", F.substring("r_digest", 1, PREFIX_HEX))


def expansions(urls: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Distinct (host, path) rows exploded into all host suffixes times the
    path prefixes of the given lengths, with digest and join key."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefix_lengths = F.filter(F.array(*[F.lit(int(n)) for n in lengths]), lambda n: n <= F.length("path"))
    d = urls.withColumn("_s", F.explode(F.array_distinct(suffixes)))
    d = d.withColumn("_n", F.explode(prefix_lengths))
    d = d.withColumn("x_digest", _digest(_expression(F.col("_s"), F.expr("substring(path, 1, _n)"))))
    return d.withColumn("x_key", F.substring("x_digest", 1, PREFIX_HEX)).select("host", "path", "x_key", "x_digest")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = (),
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """``keep`` columns plus host, path, rule and verdict for every row."""
    no_clash(keep, "host", "path", "rule", "verdict", "_u", "_h", "_p", "_v")
    d = with_parts(pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url}`").alias("_u")))
    d = d.select(*[F.col(f"`{c}`") for c in keep], "host", "path")
    r = rule_table(rules)
    # path lengths that occur in rules: at most the length of the longest rule path
    lengths = sorted(x[0] for x in r.select(F.length("r_path")).distinct().collect())
    if not lengths:
        return d.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    urls = d.select("host", "path").where(F.col("host") != "").distinct()
    hit = expansions(urls, lengths).join(r, F.col("x_key") == F.col("r_key")).where(F.col("x_digest") == F.col("r_digest"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(
        F.length("r_rule").alias("n"), F.length("r_host").alias("h"), "r_action", "r_rule")).alias("_b"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"),
                       F.col("_b.r_rule").alias("rule"), F.col("_b.r_action").alias("_v"))
    out = d.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule",
                      F.coalesce("_v", F.lit(default)).alias("verdict"))
