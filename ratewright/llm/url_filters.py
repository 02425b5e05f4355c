"""URL filters: host-suffix and path-prefix expressions against a list of rules.

Each URL is expanded into the host suffixes that have as many labels as some rule's host, joined
with the prefixes of its path that are as long as some rule's path, so a long host or path gives no
more expressions than the rules have shapes. Expressions meet rules by the first 32 bits of their
SHA-256, the full digest then confirms the rule, and of all rules that fit the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import ASCII_UPPER, small

HASH_HEX = 8
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """Host suffixes of these numbers of labels with path prefixes of these lengths."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.filter(
        F.array(*[F.when(labels >= n, F.substring_index(host, ".", -n)) for n in label_counts]).cast("array<string>"),
        lambda s: s.isNotNull(),
    )
    lengths = F.array(*[F.lit(n) for n in path_lengths]).cast("array<int>")
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n)
    )
    return F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path"))),
        )
    )


def judge(urls: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``key, url`` rows with ``host, path, rule, verdict``, one for each row of ``urls``.

    ``urls`` has columns ``key`` and ``url``, ``rules`` has ``host, path, verdict``. A rule
    fits its host and all subdomains if the path starts with the rule's path, character by
    character. The rule of most characters (host and path) wins, then the longer host, then
    ``block``. A URL that no rule fits gets ``default`` and a null rule.

    A null URL or one without ``://`` has an empty host and path: no rule with a host fits. Keys
    may be null or repeated; a repeated row comes out as often as it came in. Without rules,
    all get ``default``. Rules with a null host or path fit nothing; of repeated rules one
    counts. Other columns of ``urls`` are ignored.
    """
    rules = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select(
            F.translate("host", ASCII_UPPER, ASCII_UPPER.lower()).alias("rule_host"),
            F.col("path").alias("rule_path"),
            F.col("verdict").alias("rule_verdict"),
        )
        .distinct()
    )
    # whole numbers: the different path lengths and numbers of host labels of the rules
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().orderBy(F.length("rule_path")).collect()]
    counts = [r[0] for r in rules.select(F.size(F.split("rule_host", r"\.", -1)).alias("n")).distinct().orderBy("n").collect()]
    digest = F.sha2(F.concat_ws("\0", "rule_host", "rule_path"), 256)
    listed = rules.withColumn("rule_digest", digest).withColumn("short", F.substring("rule_digest", 1, HASH_HEX))

    parsed = urls.select("key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    none = F.lit(None).cast("struct<host:string,path:string>")
    expanded = parsed.select(
        "*",
        F.posexplode(
            F.concat(F.array(none), expressions(F.col("host"), F.col("path"), counts, lengths))
        ).alias("at", "expression"),
    ).withColumn(
        "digest",
        F.when(
            F.col("at") > 0,
            F.sha2(F.concat_ws("\0", "expression.host", "expression.path"), 256),
        ),
    )
    met = expanded.withColumn("short_hash", F.substring("digest", 1, HASH_HEX)).join(
        small(listed), F.col("short_hash") == F.col("short"), "left"
    )
    best = F.max(
        F.when(
            F.col("rule_digest") == F.col("digest"),
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                F.col("rule_verdict").alias("verdict"),
                F.concat("rule_host", "rule_path").alias("rule"),
            ),
        )
    )
    # rows of one key and URL are counted, then given back as often
    judged = met.groupBy("key", "url", "host", "path").agg(
        best.alias("best"), F.count(F.when(F.col("at") == 0, 1)).alias("times")
    )
    return judged.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(
        "key",
        "url",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
