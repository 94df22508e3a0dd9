"""Dominance counting, collocations and packing against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from showloom.llm import collocations, common, dominance, packing
from showloom.llm.common import fresh_dir


def above_by_hand(rows):
    """(key, x, y) of every row -> counts, by comparing all rows."""
    placed = [(x, y, w or 0) for _, x, y, w in rows if x is not None and y is not None]
    out = []
    for k, x, y, _ in rows:
        over = [w for a, b, w in placed if a <= x and b > y] if x is not None and y is not None else None
        out.append((k, x, y, None if over is None else len(over), None if over is None else sum(over)))
    return out


def points(n, xs, ys, hot):
    random.seed(n)
    rows = [(i, random.choice([None, *range(-xs, xs)]), random.choice([None, *range(-ys, ys)]), random.choice([None, 1, 2, 5])) for i in range(n)]
    return rows + [(n + i, 0, 1, 2) for i in range(hot)] + rows[:20] + [(None, 3, 3, 1)]


@pytest.mark.parametrize("n, xs, ys, hot, leaf", [(700, 40, 30, 300, (2, 3)), (300, 1, 200, 0, (2, 9)), (300, 200, 1, 0, (0, 0)), (1500, 300, 300, 10, (12, 18)), (1, 2, 2, 0, (3, 4))])
def test_dominance_equals_brute_force(spark, monkeypatch, n, xs, ys, hot, leaf):
    monkeypatch.setattr(dominance, "LEAF", leaf)
    rows = points(n, xs, ys, hot)
    got = dominance.count_above(spark.createDataFrame(rows, "id long, x long, y long, w long"), "id", "x", "y", "w")
    assert got.columns == ["id", "x", "y", "n_above", "w_above"]
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(above_by_hand(rows), key=order)


def test_recursion_within_a_task():
    rng = np.random.default_rng(3)
    q, n = rng.permutation(300), rng.integers(0, 9, 300)
    (got,) = dominance.within(np.arange(300) + 1024, q, [n], 9)
    assert got.tolist() == [int(n[:i][q[:i] < q[i]].sum()) for i in range(300)]


@pytest.mark.parametrize("parts", [1, 3])
def test_chunks_of_few_and_many_tasks(spark, monkeypatch, parts):
    monkeypatch.setattr(dominance, "LEAF", (1, 2))
    rows = [(i, i * 7 % 50, i * 11 % 60, 1 + i % 2) for i in range(400)]
    got = dominance.above(spark.createDataFrame([r[1:] for r in rows], "x long, y long, weight long"), parts)
    assert {tuple(r) for r in got.collect()} == {r[1:] for r in above_by_hand(rows)}


def test_dominance_over_odd_tables(spark):
    rows = points(60, 5, 5, 9)
    names = [*"kxyrqnw", "part", "place", "start", "node", "chunk", "leaf", "left", "weight", "n_above"]
    wide = spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows] * 2, "id long, `a.b` long, level long, m long, " + ", ".join(f"{c} string" for c in names))
    got = dominance.count_above(wide, "id", "a.b", "level", "m")
    assert got.columns == ["id", "a.b", "level", "n_above", "w_above"]
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted([r for r in above_by_hand(rows * 2)], key=order)
    assert dominance.count_above(wide.limit(0), "id", "a.b", "level", "m").count() == 0
    nulls = spark.createDataFrame([(1, None, 2, 1), (2, 1, None, 1)], "id long, x long, y long, w long")
    assert sorted(map(tuple, dominance.count_above(nulls, "id", "x", "y", "w").collect()))[0] == (1, None, 2, None, None)


BYTES = P.path("byte_bpe_50k.json")
TEXTS = ["", None, "One two", "It's 12 <|endoftext|> ...", "é 漢字 😀 " * 900, "x" * 30_000, " " * 200_001, "a b\n\n c " * 4000] + [f"some words of text {i} " * (i % 37) for i in range(300)]


def packed_by_hand(spark, texts, size, parts=5):
    """Checks pieces and sequences of a table against the tokenizer, returns the pieces."""
    tokenizer = Tokenizer.from_file(BYTES)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    tokens = packing.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts), fresh_dir(spark, "tokens"), BYTES, 1)
    rows = sorted((r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packing.pieces(tokens, size).collect())
    whole, reach = collections.defaultdict(list), collections.Counter()
    for s, offset, d, start, length, crc, n in rows:
        part = ids[d][start : start + length]
        assert start == reach[d] and length == len(part) > 0 and n == len(ids[d]) and offset == len(whole[s])
        assert crc == zlib.crc32(np.array(part, "<u4").tobytes())
        whole[s] += part
        reach[d] += length
    assert reach == {d: len(x) for d, x in ids.items()}
    assert sorted(whole) == list(range(len(whole))) and all(len(whole[s]) == size for s in whole if s + 1 < len(whole))
    got = {r["sequence_id"]: (r["n_tokens"], r["ids"]) for r in packing.sequences(tokens, size, pad_id=9).collect()}
    assert got.keys() == whole.keys()
    for s, (n, found) in got.items():
        short = 0 if n & (n - 1) == 0 else size - n
        assert n == len(whole[s]) and found == whole[s] + [9] * short
    return rows


@pytest.mark.parametrize("size, parts", [(2048, 5), (64, 1), (7, 3)])
def test_packing_equals_brute_force(spark, size, parts):
    packed_by_hand(spark, TEXTS, size, parts)


def test_last_sequence_at_a_power_of_two(spark):
    assert len(packed_by_hand(spark, [None] * 16, 12, 2)) == 16


def test_packing_over_odd_tables(spark):
    names = ["part", "before", "n", "ids", "at", "block", "first", "length"]
    rows = [(None if i == 3 else i // 2, t, *["clash"] * len(names)) for i, t in enumerate(TEXTS[:9])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    run = lambda df: packing.pieces(packing.encode(df, fresh_dir(spark, "tokens"), BYTES, 1))
    got = run(docs).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    want = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r["length"] for r in got) == want and {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert run(docs.limit(0)).count() == 0


def test_starts_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_OF_TOTALS", 4)
    monkeypatch.setattr(packing, "SENT", 3)
    packed_by_hand(spark, TEXTS[8:], 100, 11)


def test_other_tokenizers(tmp_path):
    encoder, word = packing.ByteEncoder(BYTES, 1), packing.ByteEncoder(P.path("word_bpe_49k.json"), 1)
    assert encoder.fast is not None and word.fast is None
    random.seed(8)
    odd = [*" \n\t'sdtrevl.,09éß漢😀　\xa0\x85​ \x00\x1c", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(random.choice([random.choice(odd), chr(random.randrange(1, 0x2FFF)), chr(random.randrange(97, 123))]) for _ in range(random.randrange(30)))
        assert encoder.ids(text) == encoder.whole(text)


def collocations_by_hand(rows, min_count, longest, percent, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if a >= min_count and len(p) > 1}
        gone = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= percent * found[p[i : i + k]]}
        best = []
        for p, a in found.items():
            score, _, left, right = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if p not in gone:
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def prose(n):
    random.seed(n)
    vocabulary = [f"w{k}" for k in range(30)] + ["The", "of", "é", "漢", "a\x00b", "0"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(random.choice(["en", "en", "de", None]), random.choice(["", " ", "\t"]).join(w + random.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in random.choices(vocabulary, weights, k=random.randrange(60)))) for _ in range(n)]
    return rows + [("en", "one hot line of words that many texts share!")] * 90 + [("en", "of of of of of of of")] * 9 + [("fr", None), ("fr", ""), (None, "w1 w2 " * 3000), ("und", "a"), ("it", "x y")]


@pytest.mark.parametrize("min_count, longest, percent, top, buckets, hot, mined", [(12, 5, 100, 2000, 1 << 20, 1 << 20, 1 << 20), (12, 5, 100, 25, 3, 60, 40), (5, 3, 80, 40, 1 << 20, 25, 1), (40, 2, 100, 2000, 64, 1 << 20, 10)])
def test_collocations_equal_brute_force(spark, monkeypatch, min_count, longest, percent, top, buckets, hot, mined):
    for name, value in (("BUCKETS", buckets), ("HOT", hot), ("MINED", mined), ("ROUTE", hot // 3), ("NUMBERED", 10 if hot < 100 else 60_000)):
        monkeypatch.setattr(collocations, name, value)
    rows = prose(250)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(docs, min_count, longest, percent, top)
    want = collocations_by_hand(rows, min_count, longest, percent, top)
    assert len(want) > 10 and sorted(map(tuple, got.collect())) == want


def test_collocations_over_odd_tables(spark):
    names = ["word", "phrase", "f", "n", "a", "l", "r", "bucket", "salt", "words", "rank", "score"]
    rows = [*prose(20), ("en", "x" * 100_000 + " y " + "long text " * 9000)]
    wide = spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows] * 2, "lang string, text string, " + ", ".join(f"{c} string" for c in names))
    got = collocations.collocations(wide, 8)
    assert sorted(map(tuple, got.collect())) == collocations_by_hand(rows * 2, 8, 5, 100, 2000)
    none = collocations.collocations(wide.limit(0), 8)
    assert none.columns == got.columns and none.count() == 0
    assert collocations.collocations(wide.select("text", F.lit(None).cast("string").alias("lang")), 10**9).count() == 0


def test_each_phrase_has_one_owner():
    texts = pa.array([t or "" for _, t in prose(60)])
    (_, words), = collocations.by_lang(iter([pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), texts], ["lang", "text"])]))
    known = collocations.Known(np.full(collocations.BUCKETS, 7), [("en", b"w0"), ("de", b"w1"), ("en", b"w3")], 100, 1 << 18)
    got = collections.Counter()
    for row in zip(*[c.to_pylist() for c in collocations.fragments_of("en", words, known, 5, 5).columns], strict=True):
        for found, n in collocations.mine([(*row[:1], 1 << 30, *row[2:])], known, 5, 5):
            got.update(dict(zip([x.decode() for x in found.to_pylist()], n.tolist(), strict=True)))
    want = collections.Counter()
    for (_, t) in prose(60):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(" ".join(w[i : i + k]) for k in range(2, 6) for i in range(len(w) - k + 1))
    assert got == want
