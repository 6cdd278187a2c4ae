"""URL rules by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapath.llm.common import LOWER, UPPER, replace_columns

DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(authority) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(authority, UPPER, LOWER), path


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column) -> Column:
    """The empty prefix and every prefix of the path that ends in a slash."""
    parts = F.split(path, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.transform(steps, lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), whole)


def _short(digest: Column) -> Column:
    """First 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``.

    ``rules`` has ``host, path, action``.  A rule fits its host and all subdomains where
    the url's path starts with the rule's path; the longest rule (host plus path, then
    host) wins, ``block`` before another action of an equal rule.  Without a fitting
    rule ``rule`` is null and the verdict is ``default``.

    Every different (host, path) is expanded once into host suffixes times path
    prefixes.  Expressions meet the rules by the first 32 bits of their SHA-256; a rule
    whose path does not end in a slash is met at its last slash.  The full digest of
    host suffix and path, cut to the rule's length, then confirms or refutes the match,
    so that a collision of short hashes has no effect.

    Null urls and those without ``://`` have empty host and path and fit no rule.  Repeated rows are
    kept; empty ``pages`` or ``rules`` are allowed.  Input columns named like an output column
    are replaced.
    """
    host, path = split_url(F.col(url))
    parsed = replace_columns(pages, host=host, path=path)
    site = F.regexp_extract("path", "^.*/", 0)
    book = (
        rules.where(F.col("host").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .select(
            F.concat("host", "path").alias("__rule"), F.col("action").alias("__action"), F.length("host").alias("__host_length"),
            F.length("path").alias("__path_length"), F.sha2(F.concat("host", "path"), 256).alias("__digest"),
            _short(F.sha2(F.concat(F.col("host"), site), 256)).alias("__short"),
        )
    )
    sites = parsed.where(F.col("host") != "").select("host", "path").distinct()
    expanded = (
        sites.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("__suffix"))
        .select("*", F.explode(path_prefixes(F.col("path"))).alias("__prefix"))
        .select("host", "path", "__suffix", _short(F.sha2(F.concat("__suffix", "__prefix"), 256)).alias("__short"))
    )
    starts = F.concat("__suffix", F.col("path").substr(F.lit(1), F.col("__path_length")))
    fits = expanded.join(book, "__short").where(F.sha2(starts, 256) == F.col("__digest"))
    rank = F.struct(F.length("__rule"), "__host_length", (F.col("__action") == "block").cast("int"), "__rule")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("__rule", "__action"), rank).alias("__best"))
    named = parsed.where(F.col("host") != "").join(best, ["host", "path"], "left")
    plain = parsed.where(F.col("host") == "").withColumn("__best", F.lit(None).cast(best.schema["__best"].dataType))
    judged = named.unionByName(plain)
    return replace_columns(
        judged, host=F.col("host"), path=F.col("path"), rule=F.col("__best.__rule"), verdict=F.coalesce("__best.__action", F.lit(default))
    ).drop("__best")
