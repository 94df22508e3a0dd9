"""Quality rules by distribution divergence, in SQL functions alone.

Two histograms of a text, of its characters by class and of its common words by word, are compared with those of each
reference language by Jensen-Shannon distance (root of the divergence in bits, 0 to 1). A text is kept if for some
language the first distance and the sum of both are within their bounds. Short texts are not judged: with under
LEAST_WORDS words the base rules alone decide.

References are means of the texts' own histograms over all documents of a language with LEAST_WORDS words or more and
the character shares of prose (PROSE_LOWER, PROSE_REST), so that a table that is mostly junk of other characters has the
references of its prose; junk that has prose's shares moves them. Languages without such documents have no reference,
and a table without any is judged by the base rules alone. References are a few rows of fixed width, so they come to the
driver and go into the expressions as constants. The counts of each text are taken in one scan and written, for both the
references and the verdicts; texts aren't shuffled.

Base rules: words are ``[^\x20\x09-\x0D]+``; a text fails with under MIN_WORDS words or with over 30 % of its words in
8-word windows that occur twice or more. Windows are compared by 64-bit hashes of word hashes.

Defined results: a null text is an empty one and fails; a null or unknown language is compared with all references;
without any reference the divergence test keeps everything; very long texts are read whole; a distance of just its bound
is within it; rows without an id are judged too, repeated rows give repeated results, an empty table gives none; other
columns, whatever their names, aren't read by judge(), and keep_good() returns them as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showloom.llm.common import blanked, cut, held, occurrences

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
LEAST_WORDS = 40
#: Bounds: of the distance between character histograms; of both distances' sum, and what it is eased by for n words,
#: over the root of n, as histograms of short texts scatter.
MAX_CHARS, MAX_SUM, EASE = 0.3, 0.27, 1.0
#: Documents that references are made of: shares of lower-case letters, at least, and of the rest class, at most.
PROSE_LOWER, PROSE_REST = 0.6, 0.02
SYMBOLS = "#*$%&|<>"
#: Common words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is"],
    "de": ["der", "die", "und", "den", "ist", "zu"],
    "fr": ["le", "les", "et", "un", "une", "des"],
    "es": ["el", "los", "que", "y", "por", "con"],
}
WORD_LIST = [w for words in COMMON.values() for w in words]
#: A character for each common word; the string of a text's common words is counted character by character.
CODES = [chr(ord("A") + i) if i < 26 else chr(ord("a") + i - 26) for i in range(len(WORD_LIST))]
#: Character classes: lower-case letters, white space, then these by patterns of what isn't in them, then the rest.
CLASSES = [r"[^\p{Lu}]+", r"[^\p{Nd}]+", r"[^.,;:?'\"()\-]+"]
LOWER, REST, N_CLASSES = 0, 5, 6


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def char_counts(text: Column, few: Column) -> list[Column]:
    """Code points by class of text (white space as blanks), of which few is without lower-case letters and blanks."""
    n, blanks = F.char_length(text), occurrences(text, " ")
    lower = n - blanks - F.char_length(few)
    counts = [lower, blanks, *[F.char_length(F.regexp_replace(few, c, "")) for c in CLASSES]]
    return [*counts, n - reduce(Column.__add__, counts)]


def common_string(words: Column) -> Column:
    """CODES of the common words among words (array), in lower case, as one string."""
    table = F.create_map(*[F.lit(x) for pair in zip(WORD_LIST, CODES, strict=True) for x in pair])
    return F.array_join(F.transform(words, lambda w: F.when(F.octet_length(w) <= max(map(len, WORD_LIST)), F.element_at(table, F.lower(w)))), "")


def code_counts(codes: Column) -> list[Column]:
    return [occurrences(codes, c) for c in CODES]


def repeated_words(hashes: Column) -> Column:
    """Words within windows of WINDOW words whose hash occurs twice or more, of the words' hashes (array<long>)."""
    windows = F.when(F.size(hashes) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])))
    return windows


def covered(windows: Column) -> Column:
    """Of window hashes (array<long>): the words under windows that occur twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), ordered)


def starts_of(ordered: Column) -> Column:
    """Ascending places of windows that share their hash with a neighbour in ordered (by hash, then place)."""
    same = lambda i, k: F.get(ordered, i + k)["h"] == F.get(ordered, i)["h"]
    marked = F.transform(ordered, lambda x, i: F.when(F.coalesce(same(i, -1), F.lit(False)) | F.coalesce(same(i, 1), F.lit(False)), x["i"]))
    return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))


def span(starts: Column) -> Column:
    """Words under windows at these places: each adds the words up to the next one, WINDOW at most."""
    each = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def with_words(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, _t (text), _b (white space as blanks), _r (_b without lower-case letters and blanks), _w (words)."""
    df = docs.select(*[F.col(k) for k in keep], whole(F.col("text")).alias("_t")).withColumn("_b", blanked(F.col("_t")))
    return df.withColumn("_r", F.regexp_replace("_b", r"[\p{Ll} ]+", "")).withColumn("_w", F.array_remove(F.split("_b", " "), ""))


def histograms(df: DataFrame) -> DataFrame:
    """df with _c (array<int>, counts by class), _k (counts by common word, then of other words) and _n (words)."""
    df = df.withColumn("_n", F.size("_w")).withColumn("_c", F.array(*char_counts(F.col("_b"), F.col("_r")))).withColumn("_s", common_string(F.col("_w")))
    return df.withColumn("_k", held(F.array(*code_counts(F.col("_s")), F.col("_n") - F.octet_length("_s"))))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x)


def known_lang(docs: DataFrame) -> Column:
    """The language of a row of docs, null in a table without that column."""
    return F.col("`lang`").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def counted(docs: DataFrame, lang: Column, *keep: str) -> DataFrame:
    """The columns keep of docs, _lang, and all counts of each text: _n, _c, _k, _nc, _words, _symbols, _dup, _rep."""
    df = histograms(with_words(docs.withColumn("_lang", lang), "_lang", *keep))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_lines", lines)
    df = df.withColumn("_win", repeated_words(F.col("_h"))).withColumn("_ord", covered(F.col("_win"))).withColumn("_starts", starts_of(F.col("_ord")))
    return df.select(
        *[F.col(k) for k in keep],
        "_lang",
        F.col("_n").cast("long").alias("_n"),
        "_c",
        "_k",
        total(F.col("_c")).alias("_nc"),
        (F.char_length("_b") - occurrences(F.col("_b"), " ")).cast("long").alias("_words"),
        reduce(Column.__add__, [occurrences(F.col("_b"), c) for c in SYMBOLS]).cast("long").alias("_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dup"),
        held(span(F.col("_starts")).cast("long")).alias("_rep"),
    )


def references_of(counts: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """language -> mean shares by character class and by common word, over all counted texts of the known languages."""
    rows = counts.filter(F.col("_lang").isin([*COMMON])).filter(F.col("_n") >= LEAST_WORDS)
    share = lambda i: F.col("_c")[i] / F.col("_nc")
    rows = rows.filter((share(LOWER) >= PROSE_LOWER) & (share(REST) <= PROSE_REST))
    means = [F.avg(share(i)).alias(f"c{i}") for i in range(N_CLASSES)] + [F.avg(F.col("_k")[i] / F.col("_n")).alias(f"k{i}") for i in range(len(WORD_LIST) + 1)]
    found = rows.groupBy("_lang").agg(*means).orderBy("_lang").collect()  # a row a known language
    return {r["_lang"]: ([r[f"c{i}"] for i in range(N_CLASSES)], [r[f"k{i}"] for i in range(len(WORD_LIST) + 1)]) for r in found}


def references(docs: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    return references_of(counted(docs, known_lang(docs)))


def distance(counts: Column, n: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram (counts, their sum n > 0) from shares that sum to 1."""

    def part(count: Column, q: Column) -> Column:
        p = count / n
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)

    each = F.zip_with(counts, F.array(*[F.lit(float(q)) for q in reference]), part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2))


def verdicts(counts: DataFrame, refs: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """counts with _js (distances from each reference; null without one), base_failed and kept."""
    both = [(distance(F.col("_c"), F.col("_nc"), c), distance(F.col("_k"), F.col("_n"), k)) for c, k in refs.values()]
    known = F.col("_n") >= LEAST_WORDS
    df = counts.withColumn("_js", F.array(*[F.struct(F.when(known, c).alias("c"), F.when(known, k).alias("k")) for c, k in both]) if both else F.lit(None).cast("array<struct<c:double,k:double>>"))
    bound = MAX_SUM + EASE / F.sqrt(F.greatest("_n", F.lit(1).cast("long")).cast("double"))
    fits = F.exists("_js", lambda x: F.coalesce((x["c"] <= MAX_CHARS) & (x["c"] + x["k"] <= bound), F.lit(True)))
    failed = (F.col("_n") < MIN_WORDS) | (100 * F.col("_rep") > MAX_REPEATED * F.col("_n"))
    return df.withColumn("base_failed", failed).withColumn("kept", held(~failed & F.coalesce(fits, F.lit(True))))


def judge(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance."""
    counts = counted(docs, known_lang(docs), "doc_id")
    if refs is None:  # counts are needed twice: of each text they are taken once, and written
        counts = cut(counts)
        refs = references_of(counts)
    df = verdicts(counts, refs)
    least = lambda k: F.array_min(F.transform("_js", lambda x: x[k]))
    names = {"_n": "n_words", "_words": "word_chars", "_symbols": "n_symbols", "_dup": "n_dup_lines", "_rep": "n_repeat_words"}
    return df.select("doc_id", *[F.col(k).alias(v) for k, v in names.items()], "base_failed", "kept", least("c").alias("char_distance"), least("k").alias("word_distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all their columns."""
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    counts = cut(counted(docs.select("text", known_lang(docs).alias("_l"), whole_row.alias("_row")), F.col("_l"), "_row"))
    return verdicts(counts, references_of(counts)).filter("kept").select("_row.*")
