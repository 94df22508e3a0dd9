"""The queries of this subpackage, each with its production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showloom.llm import collocations, decontaminate, dominance, html_text, packing, piece_codec, quality_model, quality_rules, quotes, simhash, sstable, url_filter, warc
from showloom.llm.common import fresh_dir

WORD_BPE, END_ID, PIECE_BPE, BYTE_BPE = "word_bpe_49k.json", 1, "piece_bpe_32k.model", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.fit(url_filter.seed_urls(spark)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.scores(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no quotes of its own: its messages are quoted as in mail.
    return quotes.link(quotes.as_mail(table(spark, sf_dir, "conversations")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "shards")
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_BPE), END_ID), folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))[1]


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def hours(time: Column, kind: str) -> Column:
    """Hours since 1970 of a time, which is UTC whatever the session's zone."""
    if kind == "timestamp_ntz":
        return F.unix_date(time.cast("date")).cast("long") * 24 + F.hour(time)
    return F.floor(F.unix_micros(time) / F.lit(3_600_000_000))


def op11_dominance_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    slot = hours(F.col("sold_at"), dict(sales.dtypes)["sold_at"])
    level = F.floor(F.floor(100 * F.col("total") + 0.5) / 100)
    rows = sales.select("sale_id", slot.alias("slot"), level.alias("level"), (1 + F.crc32(F.col("sale_id").cast("string")) % 2).alias("rows"))
    return dominance.count_above(rows, "sale_id", "slot", "level", "rows").withColumnsRenamed({"n_above": "n_sales", "w_above": "n_rows"})


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.encode(table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"), public_tokenizers.path(BYTE_BPE), END_ID))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_quality_classifier, op3_quality_rules, op4_html_extraction, op5_quotation_linking, op6_decontamination, op7_simhash, op8_token_shards, op9_warc, op10_sentencepiece, op11_dominance_counting, op12_collocations, op13_packing)
}

#: Shingles of five words (fewer: the whole sequence) of a table's texts, by its id.
SHINGLES = (
    "SELECT DISTINCT id, unnest(CASE WHEN len(w) < 6 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g "
    "FROM (SELECT {id} AS id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) WHERE len(w) > 0"
)



def rules_sql() -> str:
    """op3 in SQL: base counts, references by language, distances from them, verdict."""
    q, chars, words = quality_rules, range(1, quality_rules.N_CLASSES + 1), range(1, len(quality_rules.WORD_LIST) + 2)
    classes = [c.replace("'", "''") for c in q.CLASSES]
    few = ", ".join(f"length(regexp_replace(r, '{c}', '', 'g'))" for c in classes)
    common = ", ".join(f"len(list_filter(low, lambda x: x = '{w}'))" for w in q.WORD_LIST)
    symbols = " + ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in q.SYMBOLS)
    means = ", ".join([f"avg(c[{i}] / list_sum(c)) AS c{i}" for i in chars] + [f"avg(k[{i}] / n) AS k{i}" for i in words])
    term = lambda p, r: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {r})) ELSE 0 END + CASE WHEN {r} > 0 THEN {r} * log2(2 * {r} / ({p} + {r})) ELSE 0 END"
    js = lambda parts: f"sqrt(greatest(0, ({' + '.join(parts)}) / 2))"
    by_char, by_word = js(term(f"(c[{i}] / list_sum(c))", f"c{i}") for i in chars), js(term(f"(k[{i}] / n)", f"k{i}") for i in words)
    return f"""WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_replace(t, '[\\x09-\\x0D]', ' ', 'g') AS b, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM a),
c AS (SELECT *, len(w) AS n, regexp_replace(b, '[\\p{{Ll}} ]+', '', 'g') AS r, length(b) - length(replace(b, ' ', '')) AS s, list_transform(w, lambda x: lower(x)) AS low FROM b),
d AS (SELECT *, [length(b) - s - length(r), s, {few}] AS c0, [{common}] AS k0 FROM c),
e AS (SELECT doc_id, lang, t, w, l, n, s, list_append(c0, length(b) - list_sum(c0)) AS c, list_append(k0, n - list_sum(k0)) AS k FROM d),
refs AS (SELECT lang AS ref, {means} FROM e WHERE n >= {q.LEAST_WORDS} AND lang IN ({", ".join(f"'{x}'" for x in q.COMMON)}) AND c[{q.LOWER + 1}] / list_sum(c) >= {q.PROSE_LOWER} AND c[{q.REST + 1}] / list_sum(c) <= {q.PROSE_REST} GROUP BY lang),
js AS (SELECT doc_id, n, {by_char} AS dc, {by_word} AS dk FROM e, refs WHERE n >= {q.LEAST_WORDS}),
fit AS (SELECT doc_id, min(dc) AS dc, min(dk) AS dk, bool_or(dc <= {q.MAX_CHARS} AND dc + dk <= {q.MAX_SUM} + {q.EASE} / sqrt(n)) AS ok FROM js GROUP BY doc_id),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM e)),
rep AS (SELECT doc_id, count(DISTINCT i + x) AS rep FROM win, range(0, 8) AS z(x) WHERE m > 1 GROUP BY doc_id),
f AS (SELECT doc_id, n AS n_words, length(t) - s AS word_chars, {symbols} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, dc, dk, coalesce(ok, true) AS ok FROM e LEFT JOIN rep USING (doc_id) LEFT JOIN fit USING (doc_id)),
g AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept, round(dc, 6) AS char_distance, round(dk, 6) AS word_distance FROM g"""


#: SQL where it says all that the query does; the other ops are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op6_decontamination": (
        f"WITH d AS ({SHINGLES.format(id='doc_id', table='documents')}), b AS ({SHINGLES.format(id='item_id', table='benchmark')}), n AS (SELECT id, count(*) AS n FROM b GROUP BY id), "
        "w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+'), ' ') || ' ' AS t FROM documents), "
        "s AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND 4), "
        "c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS c FROM d JOIN b USING (g) GROUP BY d.id, b.id) SELECT doc_id, item_id, c / n AS containment FROM c JOIN n ON n.id = item_id WHERE c >= 0.8 * n AND item_id NOT IN (SELECT item_id FROM s) "
        "UNION ALL SELECT doc_id, item_id, 1.0 FROM w JOIN s ON contains(w.t, s.t)"
    ),
    "op3_quality_rules": rules_sql(),
    # Counts over the grid of all slots and levels: running sums along slots, then along levels. crc32 by its table of bytes.
    "op11_dominance_counting": (
        "WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)), "
        "s AS (SELECT sale_id, epoch_us(sold_at) // 3600000000 - CASE WHEN epoch_us(sold_at) % 3600000000 < 0 THEN 1 ELSE 0 END AS slot, floor(floor(100 * total + 0.5) / 100)::BIGINT AS level, "
        "1 + xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 AS m FROM sales, crc), "
        "cells AS (SELECT slot, level, count(*) AS n, sum(m) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level), "
        "grid AS (SELECT slot, level, coalesce(n, 0) AS n, coalesce(w, 0) AS w FROM (SELECT DISTINCT slot FROM cells) CROSS JOIN (SELECT DISTINCT level FROM cells) LEFT JOIN cells USING (slot, level)), "
        "along AS (SELECT slot, level, sum(n) OVER (PARTITION BY level ORDER BY slot) AS n, sum(w) OVER (PARTITION BY level ORDER BY slot) AS w FROM grid), "
        "sums AS (SELECT slot, level, coalesce(sum(n) OVER a, 0) AS n, coalesce(sum(w) OVER a, 0) AS w FROM along WINDOW a AS (PARTITION BY slot ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
        "SELECT sale_id, s.slot, s.level, n::BIGINT AS n_sales, w::BIGINT AS n_rows FROM s LEFT JOIN sums ON s.slot = sums.slot AND s.level = sums.level"
    ),
    "op12_collocations": (
        "WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents), "
        "w AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM p), "
        "g AS (SELECT lang, array_to_string(s, ' ') AS phrase, len(s) AS m FROM (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) AS s FROM w)), "
        "f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100), n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang), "
        "c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS s FROM f WHERE m > 1), "
        "k AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, s FROM c), "
        "x AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k JOIN n USING (lang) "
        "JOIN f AS l ON l.lang = k.lang AND l.phrase = array_to_string(k.s[1:k.k], ' ') JOIN f AS r ON r.lang = k.lang AND r.phrase = array_to_string(k.s[k.k + 1:], ' ')), "
        "best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1), "
        "inner_ AS (SELECT lang, a AS longer, array_to_string(v, ' ') AS phrase FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda q: list_transform(range(1, m - q + 2), lambda i: s[i:i + q - 1])))) AS v FROM c WHERE m > 2)), "
        "mx AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY ALL), "
        "o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM best LEFT JOIN mx USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a) "
        "SELECT * FROM o WHERE rank <= 2000"
    ),
    "op9_warc": (
        "WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS s FROM p), f AS (SELECT s, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY s) "
        "SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d LEFT JOIN f USING (s)"
    ),
}
