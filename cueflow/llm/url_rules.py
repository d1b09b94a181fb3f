"""URL rules as a sort-merge range join over reversed-host keys.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's.
With the host's labels reversed ("org.example"), a line feed and the path behind it, each rule is a
prefix, and a prefix is an interval of the sorted keys. A url is probed once for each of its
ancestor hosts up to the depth of the deepest rule, so a rule with a path meets subdomains too.

Probes and rules are sorted together. Within a range of keys one sweep keeps a stack of the rules
that are open: a rule is pushed where its interval begins and popped at the first key that it is
not a prefix of; what lies on the stack at a probe are all rules that fit, nested. Rules whose
interval reaches over several ranges are copied into each, so ranges are swept independently.

Equal urls are judged once and joined back, so a url that a third of the rows share is one probe.
Bounds of the ranges are read off a sample of the keys that is as large as the number of ranges
asks for; they only decide where the work is cut.

Null urls and urls without "://" have an empty host and path and fit no rule. Rules with a null
host or path are ignored; of equal rules with different verdicts "block" counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys sampled for each range when the bounds are chosen.
SAMPLED_PER_RANGE = 64


def lower_ascii(text: F.Column) -> F.Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """`pages` with `host` (A-Z lower-cased) and `path`; both empty without "://"."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return pages.withColumn("host", lower_ascii(host)).withColumn("path", path)


def _reversed_host(labels: F.Column) -> F.Column:
    return F.array_join(F.reverse(labels), ".")


def rule_intervals(rules: DataFrame) -> DataFrame:
    """(key, rule, verdict, depth): one row per distinct rule."""
    labels = F.split(lower_ascii(F.col("host")), "[.]")
    return (
        rules.filter("host is not null and path is not null")
        .select(
            F.concat(_reversed_host(labels), F.lit("\n"), F.col("path")).alias("key"),
            F.concat(lower_ascii(F.col("host")), F.col("path")).alias("rule"),
            F.col("verdict"), F.size(labels).alias("depth"),
        )
        .groupBy("key", "rule", "depth").agg(F.max("verdict").alias("verdict"))
    )


def probe_keys(urls: DataFrame, depth: int) -> DataFrame:
    """One row per (host, path) and ancestor host of at most `depth` labels."""
    labels = F.split("host", "[.]")
    n = F.least(F.size(labels), F.lit(depth))
    suffixes = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: _reversed_host(F.slice(labels, F.size(labels) - k + 1, k)))
    return (
        urls.filter("host <> '' or path <> ''")
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", F.concat("suffix", F.lit("\n"), "path").alias("key"))
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one or more ranges, each sorted by (key, rules first)."""
    stack: list[tuple[str, str, str]] = []
    part = None
    for batch in batches:
        found: list[tuple[str, str, str, str]] = []
        for p, key, name, ruling, host, path in zip(
            *(batch.column(i).to_pylist() for i in range(6)), strict=True
        ):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if name is not None:
                stack.append((key, name, ruling))
            elif stack:
                best = max(stack, key=lambda r: (len(r[1]), r[0]))
                found.append((host, path, best[1], best[2]))
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string()) for c in columns], ["host", "path", "rule", "verdict"])


def match_rules(urls: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """(host, path, rule, verdict) for distinct (host, path) that a rule fits; the longest wins.

    Longest is by the characters of host and path together.
    """
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    intervals = rule_intervals(rules)
    depth = intervals.agg(F.max("depth")).first()[0] or 0
    probes = probe_keys(urls.select("host", "path").distinct(), max(depth, 1))
    sample = (
        probes.select("key").orderBy(F.xxhash64("key"), "key").limit(ranges * SAMPLED_PER_RANGE))
    keys = sorted({row.key for row in sample.collect()}, key=lambda k: k.encode())
    bounds = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    bounds = sorted(set(bounds), key=lambda k: k.encode())
    cuts = F.array(*map(F.lit, bounds)).cast("array<string>")  # fewer than `ranges` keys

    def range_of(key: F.Column) -> F.Column:
        return F.size(F.filter(cuts, lambda cut: cut <= key))

    nothing = F.lit(None).cast("string")
    events = probes.select(
        range_of(F.col("key")).alias("part"), "key", F.lit(1).alias("kind"),
        nothing.alias("rule"), nothing.alias("verdict"), "host", "path",
    ).unionByName(
        intervals.select(
            F.explode(F.sequence(
                range_of(F.col("key")),
                F.size(F.filter(
                    cuts, lambda cut: (cut <= F.col("key")) | cut.startswith(F.col("key")))),
            )).alias("part"),
            "key", F.lit(0).alias("kind"), "rule", "verdict",
            nothing.alias("host"), nothing.alias("path"))
    )
    swept = (
        events.repartition(ranges, "part")
        .sortWithinPartitions("part", "key", "kind")
        .select("part", "key", "rule", "verdict", "host", "path")
        .mapInArrow(_sweep, "host string, path string, rule string, verdict string")
    )
    best = F.max_by(F.struct("rule", "verdict"),
                    F.struct(F.char_length("rule"), F.col("rule"))).alias("best")
    return swept.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """`pages` with host, path, rule and verdict; urls that no rule fits get `default`.

    Columns of `pages` with these names are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = with_host_and_path(pages.select(*kept), url_col)
    matched = match_rules(parsed, rules)
    return parsed.join(matched, ["host", "path"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
