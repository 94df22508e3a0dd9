"""Each operator over odd tables: nulls, empty and very long texts, rows repeated, no rows, columns with clashing names."""

import collections

import public_tokenizers as P
import pytest

from showloom.llm import decontaminate, html_text, piece_codec, quality_model, quality_rules, quotes, simhash, sstable, url_filter, warc
from showloom.llm.common import fresh_dir

WORD = P.path("word_bpe_49k.json")
TEXTS = ["a plain text of some words that go on", None, "", " \n", "A plain text of some words that go ON", "long " * 60_000, "x" * 200_000, "line\rline\r\n> quoted\n" * 30, "<p>a</p>" * 3000, "\x00\x01 é 漢 😀"]
DOCS = [(None if i == 4 else i, t) for i, t in enumerate(TEXTS)]
PAGES = [(None if i == 4 else i, None if i == 2 else f"http://h{i}.example.com/en/{i}", t) for i, t in enumerate(TEXTS)]
MESSAGES = [(None if i == 4 else i // 3, None if i == 5 else i % 3, "user", t) for i, t in enumerate(TEXTS)]
DOC, PAGE, MESSAGE = "doc_id long, text string", "page_id long, url string, html string", "conv_id long, turn long, role string, text string"
INNER = "_x _url _t _b _w _n _c _row _lang _lines _parts key fp h hash lines passages own digest first n top range start shard lang".split()


def shards(spark, df):
    folder = fresh_dir(spark, "shards")
    return sstable.read_shards(sstable.write_shards(df, folder, WORD, 1), folder).drop("start")


def items(spark):
    return spark.createDataFrame([(1, TEXTS[0]), (None, "x"), (2, None), (3, ""), (3, "long long long long long long")], "item_id long, text string")


#: operator -> rows, their schema, what it does to them.
OPERATORS = {
    "op1": (PAGES, PAGE, lambda spark, df: url_filter.judge(df, url_filter.fit(url_filter.seed_urls(spark, 200)))),
    "op2": (DOCS, DOC, lambda spark, df: quality_model.scores(df, quality_model.fit(df, spark.createDataFrame([(0, 1), (1, 0), (3, 1), (3, 0), (None, 1), (6, None)], "doc_id long, quality int")))),
    "op3": (DOCS, DOC, lambda spark, df: quality_rules.judge(df)),
    "op4": (PAGES, PAGE, lambda spark, df: html_text.extract(df)),
    "op5": (MESSAGES, MESSAGE, lambda spark, df: quotes.link(quotes.as_mail(df)).drop("place")),
    "op6": (DOCS, DOC, lambda spark, df: decontaminate.find_pairs(df, items(spark))),
    "op7": (DOCS, DOC, lambda spark, df: simhash.deduplicate(df)),
    "op8": (DOCS, DOC, shards),
    "op9": (PAGES, PAGE, lambda spark, df: warc.archive(df, fresh_dir(spark, "warc"))[1]),
    "op10": (DOCS, DOC, lambda spark, df: piece_codec.round_trip(df, P.path("piece_bpe_32k.model"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    rows, schema, run = OPERATORS[name]
    once = run(spark, spark.createDataFrame(rows, schema).repartition(2))
    found = collections.Counter(map(tuple, once.collect()))
    assert sum(found.values()) == len(rows) or name == "op6" and len(found) == 3
    taken = {c.split()[0] for c in schema.split(", ")}
    clashing = [c for c in dict.fromkeys([*once.columns, *INNER]) if c not in taken]
    wide = spark.createDataFrame([(*r, *["clash"] * len(clashing)) for r in rows] * 2, schema + "".join(f", `{c}` string" for c in clashing))
    twice = run(spark, wide)
    assert twice.columns == once.columns
    assert collections.Counter(map(tuple, twice.collect())) == collections.Counter({k: 2 * n for k, n in found.items()})
    empty = run(spark, wide.limit(0))
    assert empty.columns == once.columns and empty.count() == 0
