"""URL filters: host and path rules, then gradient-boosted trees on lexical features, in SQL functions alone.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z in lower case; path: then up to "?", "#" or the end. A
rule fits its host and all subdomains where the URL's path starts with the rule's; the longest rule wins (host and path
together; of equally long ones a blocking rule, then the first by name). Where no rule fits, trees decide.

Features are expressions over the URL, and so are the trained trees: nested CASE expressions over the feature columns.
Training takes labelled URLs, at most SAMPLE of them (those that hash least), on the driver; seed_urls() makes a set
from word lists and a fixed mixing rule, for use where no labelled URLs are at hand; both of its classes have hosts with
and without hyphens, and several features together tell them apart. Suffix statistics are counts of
the training set by last host label; those seen on fewer than SEEN training rows are at the prior, so there are
SAMPLE / SEEN at most.

Defined results: a null URL, or one without "://", has empty host and path, fits no rule, and is scored as it is (null
as an empty text); very long URLs are read whole; a URL whose score is just one half is blocked; empty tables give empty
results, and a model of an empty table scores one half; repeated rows give repeated results; other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showloom.llm.boosting import Trees, train
from showloom.llm.common import held, only

SAMPLE, SEEN, SMOOTH = 20_000, 20, 10.0
TREES, DEPTH = 20, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: host, path, whether URLs under it are allowed.
RULES = [("com", "/en/", False), ("example.com", "/en/7", True), ("net", "/de/", True), ("example.net", "/de/8", False), ("org", "/es/", False)]
#: Parts of host names for seed_urls(), of sites to block and of plain ones.
BLOCK_WORDS = "poker slots roulette pharma deals loot warez crack torrent hack miner xxx prize loan cash clicks banner popup jackpot bonus vegas diet viagra replica".split()
PLAIN_WORDS = "garden river library museum school news weather cooking travel music science history letters market bridge forest island castle morning paper village stone maple harbor studio journal market museum clinic theatre".split()
PATH_WORDS = "en de fr es news article page post item about help guide story topic archive".split()
PARAMETERS = "id q sid cat sort lang click aff src sess view size".split()
#: Ends of hosts that both classes have, and those that one has more often; half of the hosts have one of either.
SUFFIX_WORDS, BLOCK_SUFFIXES, PLAIN_SUFFIXES = "com net org info eu".split(), "top xyz click bid win".split(), "edu museum city coop gov".split()


def whole(url: Column) -> Column:
    return F.coalesce(url, F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(whole(url), PARTS, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(whole(url), PARTS, 2)


def rule(host: Column, path: Column, rules: list[tuple[str, str, bool]] = RULES) -> tuple[Column, Column]:
    """The winning rule's text (host and path), and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2], r[0] + r[1]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for h, p, _ in ordered]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, (h, p, allow) in reversed([*zip(fits, ordered, strict=True)]):
        name, verdict = F.when(fit, F.lit(h + p)).otherwise(name), F.when(fit, F.lit("allow" if allow else "block")).otherwise(verdict)
    return name, verdict


def count_of(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for none."""
    chars = F.array_distinct(F.array_remove(F.split(text, ""), ""))
    n = F.char_length(text)
    bits = F.transform(chars, lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    return F.coalesce(-F.aggregate(F.transform(F.array_sort(bits), lambda p: p * F.log2(p)), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def share(count: Column, n: Column) -> Column:
    return F.when(n > 0, count / n).otherwise(0.0)


def suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def features(url: Column, host: Column, path: Column, suffixes: dict[str, float], prior: float) -> dict[str, Column]:
    """name -> expression, all doubles."""
    url = whole(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    digits = "0123456789"
    rates = F.lit(prior)
    if suffixes:
        rates = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(suffixes.items()) for x in pair]), suffix(host)), rates)
    found = {
        "url_length": F.char_length(url),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "labels": count_of(host, ".") + 1,
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.char_length)), F.lit(0)),
        "digit_ratio": share(count_of(url, digits), F.char_length(url)),
        "host_digit_ratio": share(count_of(host, digits), F.char_length(host)),
        "host_hyphens": count_of(host, "-_"),
        "path_hyphens": count_of(path, "-_"),
        "vowel_ratio": share(count_of(host, "aeiou"), F.char_length(host)),
        "parameters": F.when(F.char_length(query) > 0, count_of(query, "&;") + 1).otherwise(0),
        "equals": count_of(query, "="),
        "query_length": F.char_length(query),
        "escapes": count_of(url, "%@~"),
        "entropy": entropy(url),
        "host_entropy": entropy(host),
        "suffix_rate": rates,
        "is_plain_http": F.startswith(url, F.lit("http:")).cast("int"),
    }
    return {k: v.cast("double") for k, v in found.items()}


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Trees, dict[str, float], float]:
    """Trees, block rate by suffix and prior of labelled (url, blocked: 0 or 1) URLs."""
    rows = labelled.filter("url is not null and blocked in (0, 1)").select("url", "blocked").orderBy(F.xxhash64("url"), "url", "blocked").limit(sample)
    rows = rows.select("url", "blocked", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    base = rows.agg(F.coalesce(F.avg("blocked"), F.lit(0.5))).first()[0]
    by = rows.groupBy(suffix(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("blocked").alias("b")).filter(F.col("n") >= SEEN).collect()  # SAMPLE / SEEN rows at most
    suffixes = {r["suffix"]: (r["b"] + SMOOTH * base) / (r["n"] + SMOOTH) for r in by if r["suffix"]}
    named = features(F.col("url"), F.col("host"), F.col("path"), suffixes, float(base))
    found = rows.select("blocked", F.array(*named.values()).alias("x")).orderBy("x", "blocked").collect()  # sample rows at most
    x = np.array([r["x"] for r in found], float).reshape(-1, len(named))
    return train(x, np.array([r["blocked"] for r in found], float), trees=TREES, depth=DEPTH), suffixes, float(base)


def tree_column(trees: Trees, k: int, columns: list[Column]) -> Column:
    """Tree k as nested CASE expressions."""
    inner = trees.feature.shape[1]

    def at(node: int) -> Column:
        if node >= inner:
            return F.lit(float(trees.leaf[k][node - inner]))
        if not math.isfinite(trees.threshold[k][node]):
            return at(2 * node + 1)
        return F.when(columns[trees.feature[k][node]] > F.lit(float(trees.threshold[k][node])), at(2 * node + 2)).otherwise(at(2 * node + 1))

    return at(0)


def judge(pages: DataFrame, model: tuple[Trees, dict[str, float], float], rules: list[tuple[str, str, bool]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row of pages (page_id, url)."""
    trees, suffixes, prior = model
    rows = only(pages, "page_id", "url").select("page_id", F.col("url").alias("_url")).withColumn("host", host(F.col("_url"))).withColumn("path", path(F.col("_url")))
    named = features(F.col("_url"), F.col("host"), F.col("path"), suffixes, prior)
    rows = rows.select("page_id", "host", "path", held(F.array(*named.values())).alias("_x"))
    margin = F.lit(trees.base)
    for k in range(len(trees.leaf)):
        margin = margin + tree_column(trees, k, [F.col("_x")[i] for i in range(len(named))])
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    score = held(1 / (1 + F.exp(-margin)))
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("_ruled"), score.alias("block_score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")


def mixed(k: int, n: int) -> int:
    """A fixed pseudo-random number below n for k."""
    k = (k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    k = (k ^ k >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (k ^ k >> 29) % n


def seed_urls(spark: SparkSession, n: int = 3000) -> DataFrame:
    """url, blocked: n URLs put together from word lists, every other one of a site to block.

    Both classes draw from the same forms, in other shares: sites to block are landing pages of hyphenated hosts, hosts
    with digits, or deep tracking links with parameters; plain ones are short sites, hyphenated names with slugs or
    dated paths, or shops with parameters. No feature alone tells the classes apart.
    """
    rows = []
    for k in range(n):
        draw = lambda i, m, k=k: mixed(32 * k + i, m)
        pick = lambda i, of, draw=draw: of[draw(i, len(of))]
        chance = lambda i, percent, draw=draw: draw(i, 100) < percent
        blocked, kind = k % 2, draw(0, 10)
        words = BLOCK_WORDS if blocked else PLAIN_WORDS
        one, two = pick(1, words), pick(2, words)
        slug = "-".join(pick(i, PATH_WORDS + PLAIN_WORDS) for i in range(3, 5 + draw(6, 3)))
        short = f"/{pick(7, PATH_WORDS)}" + (f"/{draw(8, 900)}" if chance(9, 60) else "")
        deep = "".join(f"/{pick(i, PATH_WORDS)}" for i in range(10, 12 + draw(13, 3)))
        query = "?" + "&".join(f"{pick(i, PARAMETERS)}={draw(i + 4, 10**6)}" for i in range(14, 15 + draw(22, 4)))
        if blocked:
            if kind < 5:
                name, tail = f"{one}-{two}" + ("-" + pick(23, words) if chance(24, 30) else ""), (f"/{slug}" if chance(18, 20) else short) + (query if chance(25, 20) else "")
            elif kind < 8:
                name, tail = f"{one}{two}{draw(23, 1000)}", (deep if chance(24, 60) else short) + (query if chance(25, 30) else "")
            else:
                name, tail = one + two, f"{deep}/{draw(23, 10**8)}{query}"
        elif kind < 5:
            name, tail = one + (two if chance(23, 40) else ""), short if chance(24, 60) else f"{deep}/{slug}"
        elif kind < 8:
            name, tail = f"{one}-{two}", short if chance(18, 20) else f"/{slug}" if chance(24, 50) else f"/{1995 + draw(25, 30)}/{1 + draw(23, 12)}/{slug}"
        else:
            name, tail = one + two + (str(draw(23, 100)) if chance(24, 20) else ""), short + f"?{pick(25, PARAMETERS)}={pick(18, PATH_WORDS)}"
        lead, end = pick(26, ["", "", "", "shop.", "en."]), pick(27, BLOCK_SUFFIXES if chance(28, 50) else SUFFIX_WORDS) if blocked else pick(27, PLAIN_SUFFIXES if chance(28, 50) else SUFFIX_WORDS)
        scheme = "http" if chance(29, 65 if blocked else 35) else "https"
        rows.append((f"{scheme}://{lead}{name}.{end}{tail}", blocked))
    return spark.createDataFrame(rows, "url string, blocked int")
