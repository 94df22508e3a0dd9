"""Robots rules of many hosts: parsed once a host, then looked up for every URL by its host and the prefixes of its path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showloom.functions.urls import path_of, query_of, robots_lines

RULE = "struct<place: int, allow: boolean>"
TABLE = f"host string, plain map<string, {RULE}>, sizes array<int>, patterns array<struct<regex: string, size: int, rule: {RULE}>>"


def decoded(text: Column) -> Column:
    """text without percent-escapes; as it is where they are broken."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def host_of(url: Column) -> Column:
    """Host (and port) of a URL in lower case."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1))


def rule_table(files: DataFrame, agent: str = "*") -> DataFrame:
    """TABLE of robots files (host, text): plain prefixes with their rules (place in the file, allow or not), the lengths
    of those prefixes, and rules with ``*`` or a ``$`` at the end as regular expressions.

    Of rules with one prefix the first stays, but an allowing one goes before others. A null text has no rules.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for place, (allow, path) in enumerate(robots_lines(text, agent)):
                    rows.append((host, place, allow, path))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), (), ()), (pa.string(), pa.int32(), pa.bool_(), pa.string()), strict=True)], ["host", "place", "allow", "path"])

    rules = files.select(F.lower("host").alias("host"), "text").mapInArrow(run, "host string, place int, allow boolean, path string")
    rules = rules.withColumn("special", F.rlike("path", F.lit(r"\*|\$$"))).withColumn("path", decoded(F.col("path")))
    rule = F.struct("place", "allow")
    plain = rules.filter("not special").groupBy("host", "path").agg(F.min(F.struct(~F.col("allow"), "place", "allow")).alias("x")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("x.place", "x.allow")))).alias("plain"))
    # Everything but * and a last $ stands for itself.
    literal = F.regexp_replace("path", r"([\\.\[\]{}()+?^|]|\$(?!$))", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.regexp_replace(literal, r"\*+", ".*"))
    special = rules.filter("special").groupBy("host").agg(F.collect_list(F.struct(regex.alias("regex"), F.char_length("path").alias("size"), rule.alias("rule"))).alias("patterns"))
    sizes = F.array_sort(F.array_distinct(F.transform(F.map_keys("plain"), F.char_length)))
    return plain.join(special, "host", "full").select("host", F.coalesce("plain", F.create_map().cast(f"map<string, {RULE}>")).alias("plain"), F.coalesce(sizes, F.array().cast("array<int>")).alias("sizes"), F.coalesce("patterns", F.array().cast(f"array<struct<regex: string, size: int, rule: {RULE}>>")).alias("patterns"))


def judged(urls: DataFrame, table: DataFrame, first: bool = False) -> DataFrame:
    """urls (with a column url) and allowed, by a rule_table(): a host without rules allows all.

    The rule with the longest pattern decides, an allowing one before others. With first, the first rule of the file that
    is a prefix decides, and ``*`` and ``$`` are characters like others. Paths are compared with their queries and without
    percent-escapes; a null url is allowed.
    """
    query = query_of(F.col("url"))
    target = decoded(F.concat(F.when(path_of(F.col("url")) == "", "/").otherwise(path_of(F.col("url"))), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
    rows = urls.withColumns({"_host": host_of(F.col("url")), "_target": target}).join(table.withColumnsRenamed({"host": "_host", "plain": "_plain", "sizes": "_sizes", "patterns": "_patterns"}), "_host", "left")
    # One lookup for each length that a rule of the host has.
    found = F.transform(F.filter("_sizes", lambda n: n <= F.char_length("_target")), lambda n: F.struct(n.alias("size"), F.element_at("_plain", F.substr("_target", F.lit(1), n)).alias("rule")))
    found = F.filter(found, lambda x: x["rule"].isNotNull())
    if first:
        literal = F.transform(F.filter("_patterns", lambda p: F.startswith("_target", plain_again(p["regex"]))), lambda p: F.struct(p["size"].alias("size"), p["rule"].alias("rule")))
        order = F.array_sort(F.transform(F.concat(found, literal), lambda x: F.struct(x["rule"]["place"].alias("place"), x["rule"]["allow"].alias("allow"))))
        decided = F.get(order, F.lit(0))["allow"]
    else:
        fits = F.transform(F.filter("_patterns", lambda p: F.rlike("_target", p["regex"])), lambda p: F.struct(p["size"].alias("size"), p["rule"].alias("rule")))
        decided = F.array_max(F.transform(F.concat(found, fits), lambda x: F.struct(x["size"].alias("size"), x["rule"]["allow"].alias("allow"))))["allow"]
    return rows.withColumn("allowed", F.coalesce(decided, F.lit(True))).drop("_host", "_target", "_plain", "_sizes", "_patterns")


def plain_again(regex: Column) -> Column:
    """The text that a regular expression of rule_table() was made of."""
    text = F.replace(F.substr(regex, F.lit(len("(?s)^") + 1)), F.lit(".*"), F.lit("*"))
    return F.regexp_replace(text, r"\\(.)", "$1")
