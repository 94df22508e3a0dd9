"""Text functions as column expressions: tokenizers, title normalisation, snippets, lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the vector search drops.
STOP_WORDS = (
    "a an and are as at be by for from in into is it no not of on or s such t that the their then there these they this to was will with "
    "you your yours our ours he she we i me my mine his her its them those what which who whom why how"
).split()
#: Parts of the title disambiguators.
NATIONS = ["american", "british", "canadian", "australian", "indian", "south korean", "japanese"]
MEDIA = [
    r"(?:tv|television|web|streaming)\s+series", "series", "miniseries", "anime", "cartoon", r"animated\s+series?", r"drama\s+series?", "sitcom", r"soap\s+opera",
    "telenovela", r"game\s+show", r"quiz\s+show", r"reality\s+(?:show|series)", r"talk\s+show", r"children's\s+series", r"documentary(?:\s+series)?",
]
SEPARATORS = r"[-–—_:;/.,!?]+"


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def null_as_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokenize(c: Column) -> Column:
    """array<string>: runs of a-z and 0-9 of the text in lower case."""
    return F.regexp_extract_all(F.lower(null_as_empty(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def tokenize_for_vectors(c: Column) -> Column:
    """array<string>: ASCII letter and digit runs of two characters or more, in lower case, without stop words."""
    runs = F.regexp_extract_all(null_as_empty(c), F.lit("([a-zA-Z0-9]{2,})"), F.lit(1))
    return F.filter(F.transform(runs, F.lower), lambda t: ~t.isin(STOP_WORDS))


def counted(tokens: Column) -> Column:
    """array<term, tf> of an array of tokens that isn't empty: sorted, a term's count is the length of its run."""

    def runs(all: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(all) - 1), lambda i: (i == 0) | (F.get(all, i) != F.get(all, F.greatest(i - 1, F.lit(0)))))
        return let(starts, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.struct(F.get(all, a).alias("term"), (F.coalesce(b, F.size(all)) - a).cast("long").alias("tf"))))

    return let(F.sort_array(tokens), runs)


def analyze(c: Column) -> Column:
    """array<string>: runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(null_as_empty(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column, disambiguator: str) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(c)), disambiguator, "")
    plain = F.regexp_replace(plain, r"\s*\(\d{4}.*?\)\s*$", "")
    return squeezed(F.regexp_replace(plain, SEPARATORS, " "))


def norm_title(c: Column) -> Column:
    """A title as it is matched: no medium, year or nation in brackets at its end, no separators, single blanks."""
    nation, medium = "|".join(NATIONS), "|".join(MEDIA)
    return normalize(c, rf"(?i)\s*\((?:\d{{4}}\s*)?(?:(?:{nation})\s+)?(?:{medium})\)\s*$")


def norm_query(c: Column) -> Column:
    """A query's text: only a nation's television series in brackets is dropped."""
    return normalize(null_as_empty(c), rf"(?i)\s*\((?:{'|'.join(NATIONS)})\s+(?:tv|television)\s+series\)\s*$")


def snippet(c: Column, n: int = 200) -> Column:
    return F.concat(F.substring(c, 1, n), F.when(F.char_length(c) > n, "...").otherwise(""))


def split_list(c: Column, separators: str, lower: bool = False) -> Column:
    """array<string>: trimmed parts that aren't empty."""
    parts = F.transform(F.split(null_as_empty(c), separators), lambda x: F.lower(F.trim(x)) if lower else F.trim(x))
    return F.filter(parts, lambda x: x != "")


def genres(c: Column) -> Column:
    return F.array_join(split_list(c, r"[,/|;]+"), ",")


def roles(c: Column) -> Column:
    return split_list(F.coalesce(empty_as_null(c), F.lit("cast")), ";")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s{2,}", " "))


def episode_label(title: Column, iso: Column) -> Column:
    return F.concat(null_as_empty(title), F.lit(" ("), null_as_empty(iso), F.lit(")"))


def cast_chunk(name: Column, role: Column) -> Column:
    """"name role", trimmed; null without a name."""
    name, role = empty_as_null(F.trim(name)), empty_as_null(F.trim(role))
    return F.when(name.isNotNull(), F.concat_ws(" ", name, role))


def int_or_null(c: Column) -> Column:
    """The number of a text of digits alone; anything else is null."""
    return F.when(F.rlike(c, F.lit("^[0-9]+$")), c.try_cast("int"))


def limited(c: Column, n: int = 4000) -> Column:
    return F.substring(null_as_empty(c.cast("string")), 1, n)
