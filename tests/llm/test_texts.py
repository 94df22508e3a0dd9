"""Operators on single texts against brute force and the libraries themselves."""

import collections
import hashlib
import json
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from showloom.llm import boosting, common, decontaminate, html_text, piece_codec, quality_model, quality_rules, sstable, url_filter, warc
from showloom.llm.common import fresh_dir

ODD = [None, "", " ", "\n\t\x0b\x0c\r", "a", "a b c", "▁ ▁▁x", "  two  spaces ", "Tabs\tand\x0bfeeds\r\n", "é 漢字 😀 ＡＢＣ", "<|endoftext|> <|ENDOFTEXT|> it's I'LL", "x" * 5000, "w " * 3000, "A\u0301 \u0301b \u212b", "ŒUVRE İI", "no\u00a0break\u2028line", "1,234.5 a. b, c.d e..", "\x00nul"]

CODEC, ENCODER = piece_codec.Codec(P.path("piece_bpe_32k.model")), sstable.WordEncoder(P.path("word_bpe_49k.json"), 1)


def docs_of(spark, texts):
    rows = [(i if i % 5 else (None if i == 5 else i), t, "en", "s", 0, "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `start` string")


@pytest.fixture(scope="session")
def texts(spark, sf):
    return ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_sentencepiece_equals_the_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = docs_of(spark, texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = collections.Counter((r["doc_id"], len(ids := model.encode(r["text"] or "")), sha(",".join(map(str, ids))), sha(model.decode(ids))) for r in docs.collect())
    assert collections.Counter(map(tuple, piece_codec.round_trip(docs, P.path("piece_bpe_32k.model")).collect())) == want
    assert piece_codec.round_trip(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" ▁ab\n\t.é漢\x00😀</s>1'", max_size=30), max_size=4))
def test_sentencepiece_chunks(many):
    codec = CODEC
    for text, (n, ids, out) in zip(many, codec.run(many), strict=True):
        want = codec.model.encode(text)
        assert (n, ids, out) == (len(want), ",".join(map(str, want)), codec.model.decode(want))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" ab\n\tZ.,'sÉéßÿ×漢\u0301\u0130\x00<|endoftext|>0", max_size=30), max_size=4))
def test_word_encoder(many):
    ids, ends = ENCODER.encode(pa.array(["skipped", *many], pa.string()).slice(1))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in many]


def test_token_shards(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs, folder = docs_of(spark, texts), fresh_dir(spark, "shards")
    summary = sstable.write_shards(docs, folder, P.path("word_bpe_49k.json"), 1)
    got = sstable.read_shards(summary, folder).collect()
    own = {}
    for r in docs.collect():
        own.setdefault(r["doc_id"], []).append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    start = 0
    for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = own[r["doc_id"]][0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert len(got) == len(texts)
    shards = [sstable.Shard(folder, r["shard"]) for r in summary.collect()]
    for doc_id in [None, 7, 41, 111]:
        assert [x.tolist() for s in shards for x in s.get(doc_id)] == own[doc_id]
    assert not [x for s in shards for k in range(10_000, 10_400) for x in s.get(k)]
    assert sum(s.may_hold(k) for s in shards for k in range(10_000, 14_000)) < 0.03 * 4000 * len(shards)
    empty = fresh_dir(spark, "shards")
    assert sstable.read_shards(sstable.write_shards(docs.limit(0), empty, P.path("word_bpe_49k.json"), 1), empty).count() == 0


def test_word_encoder_of_large_strings_and_other_tokenizers(tmp_path):
    from tokenizers import Tokenizer

    many = ["First text. It's 12,5", None, "", "zweiter  Text<|endoftext|>", "<|EndOfText|> x"]
    want = [ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids for t in many]
    for kind in (pa.string(), pa.large_string()):
        (batch,) = [*sstable.text_slices([pa.RecordBatch.from_arrays([pa.array(many, kind)], ["text"])], "text")]
        ids, ends = ENCODER.encode(batch[1])
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == want
    spec = json.loads(ENCODER.tokenizer.to_str())
    spec["normalizer"]["normalizers"].pop()  # cases differ now
    path = str(tmp_path / "other.json")
    Tokenizer.from_str(json.dumps(spec)).save(path)
    other = sstable.WordEncoder(path, 1)
    ids, ends = other.encode(pa.array([t or "" for t in many]))
    assert ENCODER.by_words and not other.by_words
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in many] != want


def test_shards_are_sized_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD", 1000)
    docs = spark.createDataFrame([(i, "word " * 40, "clash") for i in range(60)], "doc_id long, text string, h string")
    summary = sstable.write_shards(docs, fresh_dir(spark, "shards"), P.path("word_bpe_49k.json"), 1)
    assert summary.count() == 12 and summary.agg(F.sum("n_docs")).first()[0] == 60


def test_codec_of_a_model_that_needs_whole_texts(monkeypatch):
    many = ["a b", "", None, "  so  it  is "]
    want = [*CODEC.run(many)]
    monkeypatch.setattr(piece_codec.Codec, "chunks", lambda self, text: [piece_codec.MARK + x for x in text.split()])
    other = piece_codec.Codec(P.path("piece_bpe_32k.model"))
    assert CODEC.by_chunks and not other.by_chunks and [*other.run(many)] == want


def test_shard_keeps_repeated_ids(spark):
    folder = fresh_dir(spark, "shards")
    docs = spark.createDataFrame([(3, "a b"), (3, "a b"), (3, "c"), (1, None)], "doc_id long, text string")
    summary = sstable.write_shards(docs, folder, P.path("word_bpe_49k.json"), 1, shards=2)
    assert sorted(r["doc_id"] for r in sstable.read_shards(summary, folder).collect()) == [1, 3, 3, 3]
    assert sum(len(sstable.Shard(folder, r["shard"]).get(3)) for r in summary.collect()) == 3


def rules_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) for k in range(8) if windows[tuple(words[i : i + 8])] > 1}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def test_quality_rules(spark, texts):
    more = ["a b c d e f g h i j " * 2 + "x y z " * 9, "same line\nsame line\n\nother\nsame line", "one two three four five six seven eight " * 3]
    docs = docs_of(spark, texts + more)
    got = quality_rules.judge(docs).withColumnRenamed("doc_id", "id").collect()
    want = collections.Counter((r["doc_id"], *rules_by_hand(r["text"])) for r in docs.collect())
    assert collections.Counter((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_quality_rules_spare_short_texts(spark, sf):
    refs = quality_rules.references(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = [" ".join(f"{w}%%{i}" for i in range(n)) for n in (19, 20, 39, 40, 400) for w in ("|", "XY")]
    got = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), refs).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [False] * 2 + [True] * 4 + [False] * 4
    assert [r["char_distance"] is None for r in got] == [True] * 6 + [False] * 4
    assert quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("kept").count() == 8  # no references


def test_quality_rules_divergence(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    refs = quality_rules.references(docs)
    assert set(refs) == {"en", "de", "fr", "es"}
    assert all(abs(sum(h) - 1) < 1e-9 for both in refs.values() for h in both)
    clean = docs.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"), "doc_id").filter("lang = 'en' and n_chars > 800").first()["text"]
    bad = [clean.upper(), " ".join(f"{w}%%%" for w in clean.split()), " | ".join(w for w in clean.split() if len(w) > 5)]
    got = [r["kept"] for r in quality_rules.judge(spark.createDataFrame([(i, t) for i, t in enumerate([clean, *bad])], "doc_id long, text string"), refs).orderBy("doc_id").collect()]
    assert got == [True, False, False, False]
    kept = quality_rules.keep_good(docs.withColumn("_w", F.lit(1)))
    assert kept.columns == [*docs.columns, "_w"]
    judged = quality_rules.judge(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in judged.filter("kept").collect())


def test_quality_model(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.fit(docs, labels)
    rows = quality_model.scores(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) > 0.95 * len(held) > 50
    again = docs.drop("lang").withColumn("quality", F.lit(7)).withColumn("source", F.lit(None))
    assert [r["score"] for r in quality_model.scores(again, quality_model.fit(again, labels)).orderBy("doc_id").collect()] == [r["score"] for r in quality_model.scores(docs, model).orderBy("doc_id").collect()]
    odd = quality_model.scores(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    none = quality_model.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_model.scores(docs_of(spark, ODD), none).collect()} == {0.5}
    assert quality_model.scores(docs.limit(0), model).count() == 0


LONG = "Sentences of the article run on for a while, so that the window fills. " * 3
PAGES = [
    (None, ""),
    ("", ""),
    ("plain words &amp; more", "plain words & more"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy {LONG}</div><article><h1>Head&nbsp;line</h1><p>{LONG}<p><b>Short<br>one</b><ul><li>x</li><li>y</li></ul><script>var t='</p>'</script></article><aside>{LONG}</aside><footer>&copy; me</footer>", f"Head line\n{LONG.strip()}\nShort one\nx\ny"),
    (f"<div id=top-menu>{LONG}</div><div class=story><p>{LONG}</p><p>tiny</p></div><section id='comments'><p>{LONG}</p></section><form>{LONG}</form><p hidden>{LONG}</p>", f"{LONG.strip()}\ntiny"),
    (f"<main><p>{LONG}<p>a &lt;b&gt; &#233;&#x2014;&eacute;</main><div>{LONG}</div>", f"{LONG.strip()}\na <b> é—é"),
    ("<article><p>cut off <b>here</b> and <a hre", "cut off here and"),
    (f"<body class='no-sidebar has-comments'><div><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div><!-- <p>hidden</p> -->", LONG.strip()),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, None if i == 2 else f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, `text` string")
    got = html_text.extract(pages).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [t for _, t in PAGES]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_windows_decide_in_marked_pages():
    story, card = f"<p>{LONG}</p><p>{LONG}</p>", "<article><h3><a href=x>Another story</a></h3><p>A short teaser that leads to it.</p></article>"
    for page in (f"<div>{story}</div>{card}", f"{card}<div>{story}</div>", f"{card * 9}<div>{story * 2}</div>{card}"):
        assert html_text.main_text(page).count(LONG.strip()) == page.count(LONG)
    assert html_text.main_text(f"<article>{story}<p><a href=x>All of it a link</a></p></article><div>{LONG}</div>") == f"{LONG.strip()}\n{LONG.strip()}\nAll of it a link"
    lone = "<article><p>Two short words</p></article>" + "<ul>" + "<li><a href=x>elsewhere</a></li>" * 4 + f"</ul><div>{LONG}</div>"
    assert html_text.main_text(lone) == LONG.strip()


def test_html_keeps_titles_and_endings():
    advert, body = "<div class=ad>Buy</div><div class=share><p>one</p><p>two</p><p>three</p></div>", f"<p>{LONG}</p>" * 2
    text = ["A headline", "By Me", "12 May 2001", LONG.strip(), LONG.strip()]
    top = "<h1>A headline</h1><div>By Me</div><div>12 May 2001</div>"
    assert html_text.main_text(f"<div>{top}{body}</div>").split("\n") == text
    assert html_text.main_text(f"<div>{top}{advert}{body}{advert}<p>The end.</p></div>").split("\n") == [*text, "The end."]
    assert html_text.main_text(f"<div>{body}<p><a href=x>A paragraph of links</a></p>{body}<p><a href=y>The last one</a></p></div>").split("\n") == [*text[3:], "A paragraph of links", *text[3:], "The last one"]
    menu = "<ul>" + "<li><a href=x>elsewhere</a></li>" * 4 + "</ul>"
    assert html_text.main_text(f"{menu}<div>{body}</div>{menu}<div>short</div>{menu}").split("\n") == text[3:]


def test_html_keeps_what_surrounds_foreign_elements():
    page = lambda x: f"<article><p>one</p>{x}<p>two</p><p>three</p></article>"
    for x in ("<svg width='1'/>", "<svg><title>t</title></svg>", "<svg>", "<iframe src=x />", "<noscript>", "<object data=x></object>", "<svg/>" * 50, "<math/>"):
        assert html_text.main_text(page(x)) == "one\ntwo\nthree", x
    assert html_text.main_text(page("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>")) == "one\nso x=2 holds\ntwo\nthree"


def test_html_names_of_subjects_and_of_boilerplate():
    of = lambda a: html_text.main_text(f"<div><p>{LONG}</p><div {a}><p>{LONG}More.</p></div><p>{LONG}</p></div>").count("More.")
    for a in ('id="related-work"', 'class="search-theory"', 'id="reply-to-critics"', 'class="notice-period"', 'class="x legal-history"', 'id=social-contract', 'class="alert-fatigue"', 'class="response-times"'):
        assert of(a) == 1, a
    for a in ('class="related"', 'class="related-posts"', 'id="search-box"', 'class="reply-form"', 'class="x notice"', 'id=comments', 'class="comment-body"', 'class="cookie-notice"', 'role=search', 'class="legal-notice"', 'id="comment-17"', 'class="ad ad-300"', 'class="js-share-buttons"'):
        assert of(a) == 0, a


def choose_by_hand(weights):
    """Lines between the first and the last weighing one of a run of windows that aren't empty, if one of them surges."""
    n, window = len(weights), lambda i: sum(weights[i : i + 3])
    kept = set()
    for a in range(n):
        for b in range(a, n):
            if all(window(i) for i in range(a, b + 1)) and max(window(i) for i in range(a, b + 1)) >= 80:
                own = [i for i in range(a, b + 1) if weights[i]]
                kept.update(range(own[0], own[-1] + 1) if own else ())
    return [i in kept if kept else w > 0 for i, w in enumerate(weights)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 5, 26, 27, 40, 79, 80, 200]), max_size=16))
def test_html_windows_equal_brute_force(weights):
    assert html_text.chosen(weights) == choose_by_hand(weights)


def made_page(k):
    """A page of divs without any name, and its main text: link lists and short lines stand apart from the story."""
    draw = np.random.default_rng(k)
    links = lambda n: "<ul>" + "".join(f"<li><a href=/{i}>Elsewhere {i}</a></li>" for i in range(n)) + "</ul>"
    story = [f"Paragraph {i} of page {k}. " + "It goes on for a while &amp; then some. " * int(draw.integers(2, 5)) for i in range(int(draw.integers(2, 9)))]
    notes = "".join(f"<div>Note {i}</div>" for i in range(int(draw.integers(1, 4))))
    page = f"<div>{links(4)}{notes}{links(5)}<div><h1>Story {k}</h1>" + "".join(f"<p>{x}</p>" for x in story) + f"</div>{links(6)}{notes}{links(3)}</div>"
    return page, "\n".join([f"Story {k}", *(x.replace("&amp;", "&").strip() for x in story)])


def test_html_windows_decide_in_unmarked_pages(monkeypatch):
    pages = [made_page(k) for k in range(60)]
    assert [html_text.main_text(p) for p, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(html_text, "chosen", lambda weights: [w > 0 for w in weights])
    assert sum(html_text.main_text(p) != t for p, t in pages) == len(pages)


def test_html_of_pages_put_together(sf):
    """Articles, with boilerplate of all kinds between their blocks, marked or not: the article's blocks come back."""
    boilerplate = ["<nav><a href=x>Home</a></nav>", f"<aside>{LONG}</aside>", f"<div class='ad'>{LONG}</div>", "<script>if (a < b) { c('</p>') }</script>", f"<form><p>{LONG}</p></form>", f"<!-- {LONG} -->", f"<div id=cookie-notice>{LONG}</div>", f"<footer>{LONG}</footer>", "<style>p{}</style>", f"<ol class=commentlist><li>{LONG}</li></ol>"]
    for k in range(200):
        draw = np.random.default_rng(k)
        blocks, parts = [], []
        for i in range(int(draw.integers(1, 8))):
            parts += [boilerplate[j] for j in draw.integers(0, len(boilerplate), int(draw.integers(0, 3)))]
            text = f"Block {i} says &lt;{k}&gt;: {LONG}"
            blocks.append(" ".join(text.replace("&lt;", "<").replace("&gt;", ">").split()))
            kind = ["p", "div", "blockquote", "pre"][int(draw.integers(0, 4))]
            parts.append(f"<{kind}>{text.replace('. ', '.<br>  ', 1)}</{kind}>")
        tag = ["div", "article", "main", "section"][k % 4]
        assert html_text.main_text(f"<html><body><{tag}>{''.join(parts)}</{tag}></body></html>") == "\n".join(blocks)


@pytest.mark.parametrize("opened", ["<div>", "<p>", "<b>", "<div></b>", "<svg>", "<a href=x>", "<ul><li>", "<div/>"])
def test_html_takes_time_in_proportion(opened):
    took = []
    for n in (4000, 16000):
        began = time.process_time()
        html_text.main_text(opened * n + "words")
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.02)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp=\"'! -&;divstyle\n", max_size=60))
def test_html_never_fails(text):
    assert "\n\n" not in html_text.main_text(text)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/725?x#y", "https://a.example.com/en/8", "x://example.com/fr/", "http://b.net/de/1", "http://example.net/de/85", "http://example.net/de/9", "http://notexample.net/de/85", "http://org/es/", "http://a.org?es", "http://casino-win.example.org/fr/1", "http://river.example.org/fr/1", "http://É.com/en/\n#z", "http://" + "a" * 20_000 + ".com/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.fit(url_filter.seed_urls(spark, 600))).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1]), u
        assert got[i]["verdict"] in ("allow", "block") and (not best or got[i]["verdict"] == ("allow" if best[2] else "block"))
    assert (got[13]["verdict"], got[14]["verdict"]) == ("block", "allow")
    assert "Python" not in url_filter.judge(pages, url_filter.fit(url_filter.seed_urls(spark, 60)))._jdf.queryExecution().toString()


def test_seed_urls_need_several_features(spark):
    rows = url_filter.seed_urls(spark).collect()
    hyphens = collections.Counter((r["blocked"], "-" in r["url"].split("/")[2]) for r in rows)
    assert min(hyphens[b, h] for b in (0, 1) for h in (False, True)) > 300
    trees, suffixes, prior = url_filter.fit(spark.createDataFrame(rows[:2000]))
    used = collections.Counter(trees.feature[np.isfinite(trees.threshold)].tolist())
    assert len(used) >= 5 and max(used.values()) < 0.5 * sum(used.values())
    named = url_filter.features(F.col("url"), url_filter.host(F.col("url")), url_filter.path(F.col("url")), suffixes, prior)
    x = np.array([r["x"] for r in spark.createDataFrame(rows).select(F.array(*named.values()).alias("x")).collect()])
    y = np.array([r["blocked"] for r in rows])
    for values in x.T:  # no feature alone
        assert all(0.15 < np.mean((values > t) == y) < 0.85 for t in np.unique(values)[:-1])
    held = spark.createDataFrame([(i, r["url"]) for i, r in enumerate(rows[2000:])], "page_id long, url string")
    right = collections.defaultdict(list)
    for r in url_filter.judge(held, (trees, suffixes, prior), []).collect():
        blocked = rows[2000 + r["page_id"]]["blocked"]
        right[blocked, "-" in r["host"]].append((r["verdict"] == "block") == bool(blocked))
    assert len(right) == 4 and all(len(v) > 80 and np.mean(v) > 0.85 for v in right.values()), {k: np.mean(v) for k, v in right.items()}


def features_by_hand(url, suffixes, prior):
    url = url or ""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    query = (re.match(r"(?s)^[^?#]*\?([^#]*)", url) or [None, ""])[1]
    count = lambda t, chars: sum(c in chars for c in t)
    bits = lambda t: -sum(n / len(t) * np.log2(n / len(t)) for n in collections.Counter(t).values()) if t else 0.0
    ratio = lambda t, chars: count(t, chars) / len(t) if t else 0.0
    digits = "0123456789"
    return [
        len(url), len(host), len(path), sum(x != "" for x in path.split("/")), host.count(".") + 1, max(map(len, host.split("."))), ratio(url, digits), ratio(host, digits), count(host, "-_"), count(path, "-_"),
        ratio(host, "aeiou"), count(query, "&;") + 1 if query else 0, query.count("="), len(query), count(url, "%@~"), bits(url), bits(host), suffixes.get(host.split(".")[-1], prior), int(url.startswith("http:")),
    ]


def walk(trees, x):
    """The margin of one row, node by node."""
    out = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        out += leaf[node - len(feature)]
    return out


def test_url_scores_equal_brute_force(spark):
    rows = url_filter.seed_urls(spark).collect()
    model = url_filter.fit(spark.createDataFrame(rows[:2000]))
    trees, suffixes, prior = model
    assert len(suffixes) > 8 and set(suffixes) <= set(url_filter.SUFFIX_WORDS + url_filter.BLOCK_SUFFIXES + url_filter.PLAIN_SUFFIXES)
    urls = [r["url"] for r in rows[2000:2300]] + [None, "", "no scheme", "http://", "HTTP://WWW.a-b_c.Info/x//y?z=%41&b;c#d?e", "https://é.top/ü?q", "http://" + "a1." * 3000 + "xyz/" + "p/" * 2000]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), model, []).orderBy("page_id").collect()
    for r, u in zip(got, urls, strict=True):
        want = 1 / (1 + np.exp(-walk(trees, features_by_hand(u, suffixes, prior))))
        assert abs(r["block_score"] - want) < 1e-9 and r["verdict"] == ("block" if r["block_score"] >= 0.5 else "allow"), u
    empty = url_filter.fit(spark.createDataFrame(rows[:1]).limit(0))
    assert {r["block_score"] for r in url_filter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), empty).collect()} == {0.5}


def test_trees_beat_the_best_single_feature(spark):
    rows = url_filter.seed_urls(spark).collect()
    trees, suffixes, prior = url_filter.fit(spark.createDataFrame(rows[:2000]))
    x, y = np.array([features_by_hand(r["url"], suffixes, prior) for r in rows]), np.array([r["blocked"] for r in rows])
    stumps = [(np.mean((x[:2000, f] > t) == y[:2000]), f, t) for f in range(x.shape[1]) for t in np.unique(np.quantile(x[:2000, f], np.linspace(0, 1, 65)))]
    best = max(max(stumps), max((1 - a, f, t) for a, f, t in stumps))
    alone = np.mean((x[2000:, best[1]] > best[2]) == y[2000:])
    assert np.mean((trees.score(x[2000:]) >= 0.5) == y[2000:]) > max(alone, 1 - alone) + 0.15
    families = {"length": {0, 1, 2, 5, 13}, "depth": {3, 4}, "digits": {6, 7}, "entropy": {15, 16}, "parameters": {11, 12}, "suffix": {17}}
    used = set(trees.feature[np.isfinite(trees.threshold)].tolist())
    assert sum(bool(used & own) for own in families.values()) >= 4


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 120), st.integers(1, 4))
def test_boosted_trees_equal_a_scalar_walk(seed, n, depth):
    draw = np.random.default_rng(seed)
    x, y = draw.integers(0, 6, (n, 4)).astype(float), draw.integers(0, 2, n).astype(float)
    trees = boosting.train(x, y, trees=5, depth=depth, least=2)
    some = np.vstack([x, draw.normal(0, 9, (20, 4))])
    assert np.allclose(trees.margin(some), [walk(trees, row) for row in some])
    if n and y.min() != y.max():  # a tree's leaves lower the loss of the rows that it was grown on
        loss = lambda m: np.mean(np.log1p(np.exp(np.where(y > 0, -m, m))))
        assert loss(trees.margin(x)) <= loss(np.full(n, trees.base)) + 1e-9


def statistics_by_hand(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return [0.0] * quality_model.NAMES
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:?'\"()-", b"!", b"#$%&*", b"|<>=_/\\{}[]~^`+@", bytes(range(128, 256))]
    sizes, n, lines = [len(w) for w in words], len(words), [x for x in data.split(b"\n") if x.strip()]
    mean = sum(sizes) / n
    out = [np.log(1 + len(data)), np.log(1 + n), *[sum(b in g for b in data) / len(data) for g in groups], mean, (sum((s - mean) ** 2 for s in sizes) / n) ** 0.5, max(sizes), len(set(words)) / n, len(set(words)) / n**0.5]
    out += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(lines)) / len(lines), n / len(lines), sum(b in b".!?" for b in data) / n, max(collections.Counter(sizes).values()) / n]
    lead = [w[0] for w in words]
    return out + [sum(b in groups[0] for b in lead) / n, sum(b in groups[1] for b in lead) / n, sum(not (b in groups[0] or b in groups[1] or b > 127) for b in lead) / n]


def test_statistics_and_scores_equal_brute_force(spark, sf, texts):
    for t in texts:
        assert np.allclose(quality_model.statistics(t), statistics_by_hand(t)), t
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1.0, 2) for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted int")
    model = quality_model.fit(docs, spark.createDataFrame([(i, (len(t or "") % 1000) // 500) for i, t in enumerate(texts)], "doc_id long, quality int"))
    assert np.isfinite(model.threshold).any()
    want = collections.Counter()
    for i, t in enumerate(texts):
        score = 1 / (1 + np.exp(-walk(model, statistics_by_hand(t))))
        want[i if i != 5 else None, zlib.crc32(str(i).encode()) % 3 == 1 and i != 5, round(score, 6), int(score >= 0.5)] += 1
    got = collections.Counter((r["doc_id"], r["held_out"], round(r["score"], 6), r["predicted"]) for r in quality_model.scores(docs, model).collect())
    assert got == want


def held_by(doc, item):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    n = min(5, len(words(item)))  # a shorter item is one shingle of its own length

    def shingles(w):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    a, b = shingles(words(doc)), shingles(words(item))
    return len(a & b) / len(b) if b else 0.0


@pytest.mark.parametrize("most", [decontaminate.MOST, 3000])
def test_decontamination(spark, sf, texts, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST", most)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "a b c"), (901, None), (902, ""), (None, "a b"), (903, "w w w w w w w"), (904, "one Two three"), (905, "lonely"), (906, "b c"), (906, "b c"), (906, "other words of this id that are many")] + [(907, "one id with a long text " * 40 + str(k % 3)) for k in range(9)]
    w = items[5][1].split()
    more = [" ".join(["Prefix"] + w[: int(len(w) * f)] + ["tail"]) for f in (0.3, 0.7, 0.8, 0.85, 0.9, 1)] + [" ".join(w[:9] + ["odd"] + w[9:]), "A  B\tc", "x " * 900 + "one\ttwo  THREE" + " y" * 900, "LONELY at the end", "not lone ly", "two three one", items[-1][1], "z" + items[-2][1]]
    docs, benchmark = docs_of(spark, texts + more), spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter((r["doc_id"], i, round(s, 9)) for r in docs.collect() for i, t in items if i is not None and (s := held_by(r["text"], t)) >= 0.8)
    got = collections.Counter((r["doc_id"], r["item_id"], round(r["containment"], 9)) for r in decontaminate.find_pairs(docs, benchmark).collect())
    assert got == want and len(want) > 5
    hit = {d for d, _, _ in want}
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(docs, benchmark).collect()) == sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in hit or r["doc_id"] is None and not any(held_by(r["text"], t) >= 0.8 for _, t in items))
    assert decontaminate.find_pairs(docs, benchmark.limit(0)).count() == 0


def made_items(n, seed=3):
    """n items of 5 to 400 words out of a vocabulary of 9,000."""
    draw = np.random.default_rng(seed)
    return [(i, " ".join(f"w{k}" for k in draw.integers(0, 9000, int(5 * 1.06 ** (i % 75))))) for i in range(n)]


def test_decontamination_finds_all_of_a_large_vocabulary():
    items = made_items(600)
    index, draw = decontaminate.Items(items), np.random.default_rng(4)
    assert len(index.vocabulary) > 7200 and len(index.partitions) > 5
    found = wanted = 0
    for k in range(40):
        parts = [t.split() for _, t in (items[j] for j in draw.integers(0, len(items), 3))]
        parts[0] = parts[0][: max(4, int(len(parts[0]) * draw.uniform(0.7, 1)))]
        doc = " ".join([" ".join(f"w{x}" for x in draw.integers(0, 9000, 200)), *[" ".join(p) for p in parts]])
        want = {(i, round(s, 9)) for i, t in items if (s := held_by(doc, t)) >= 0.8}
        got = {(i, round(s, 9)) for i, s in index.search(doc)}
        assert got <= want
        found, wanted = found + len(got), wanted + len(want)
    assert found == wanted > 50  # a recall of 1


def test_decontamination_partitions_save_work(monkeypatch):
    items = [x for x in made_items(600) if len(x[1].split()) > 8]
    doc = " ".join(t for _, t in items[100:130])
    looked, found = [], []
    for one in (False, True):
        if one:
            monkeypatch.setattr(decontaminate, "partition_of", lambda size: 0)
        index = decontaminate.Items(items)
        found.append(index.search(doc))
        looked.append(index.looked / (len(index.partitions) * len(doc.split())))
        index.looked = 0
        index.search(" ".join(items[0][1].split()))  # a short one: few partitions are looked at
        looked.append(index.looked / len(items[0][1].split()))
    assert found[0] == found[1] and len(found[0]) >= 30
    assert looked[0] < 0.6 < looked[2] and looked[1] <= 2


def test_decontamination_is_exact_when_hashes_collide(monkeypatch):
    monkeypatch.setattr(decontaminate, "hashed", lambda runs: (runs.sum(axis=1) % 7).astype(np.uint64))
    items = made_items(40)
    index = decontaminate.Items(items)
    for doc in (items[20][1], " ".join(reversed(items[30][1].split())), items[1][1] + " " + items[39][1]):
        assert {(i, round(s, 9)) for i, s in index.search(doc)} == {(i, round(s, 9)) for i, t in items if (s := held_by(doc, t)) >= 0.8}


def test_benchmark_blocks_come_one_by_one(spark, sf, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST", 3000)
    made = []
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    parts = decontaminate.blocks(benchmark)
    assert iter(parts) is parts and sum(map(len, parts)) == benchmark.count()
    blocks = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "blocks", lambda b: (made.append(len(x)) or x for x in blocks(b)))
    decontaminate.find_pairs(spark.read.parquet(f"{sf}/documents.parquet"), benchmark)
    assert len(made) > 3 and sum(made) == benchmark.count()


@pytest.mark.parametrize("sent,captures,lines", [(warc.SENT, warc.CAPTURES, warc.LINES), (0, 20, 7)])
def test_warc(spark, sf, sent, captures, lines, monkeypatch):
    for name, value in (("SENT", sent), ("CAPTURES", captures), ("LINES", lines)):
        monkeypatch.setattr(warc, name, value)
    base = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    same = base[3][2]
    pages = base + [(1000, "http://x.com/a b\r\nc", same), (1001, None, same), (1002, "u", None), (1003, "u", ""), (1004, "s", "x" * 99), (1005, "s", "x" * 99), (1006, "s", "é" * 50), (1007, "s", "é" * 50), (None, "n", same), (2, "again", same), (2000, "l", "y" * 300_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    folder = fresh_dir(spark, "warc")
    directory, records = warc.archive(df, folder)
    first = {}
    for page_id, _, h in pages:
        if page_id is not None and len((h or "").encode()) >= 100:
            first[h] = min(page_id, first.get(h, page_id))
    want = collections.Counter()
    for page_id, _, h in pages:
        data = (h or "").encode()
        refers = first.get(h) if first.get(h) != page_id else None
        want[(page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    assert collections.Counter(map(tuple, records.collect())) == want
    lookup = warc.Lookup(directory, folder)
    for page_id, url, h in base[:20]:
        found = [c for c in lookup.captures(url) if c["page_id"] == page_id]
        assert len(found) == 1 and (found[0]["type"] == "revisit" or lookup.payload(found[0]) == h.encode())
    assert not lookup.captures("http://nowhere.example/zzz") and not lookup.captures("http://zzz.zzz/zzz") and [c["page_id"] for c in lookup.captures("")] == [1001]
    at = lookup.captures(base[3][1])[0]
    fields, _, _ = warc.parse(lookup.read(at["filename"], at["offset"], at["length"]))
    assert (fields["Showloom-Page-Id"], fields["Showloom-Refers-To-Page-Id"]) == ("3", "2")
    files = {c["file"] for c in warc.captures_of(directory, folder).collect()}
    heads = [warc.gzip.decompress(lookup.read(f, 0, lookup.fs.get_file_info(f"{lookup.path}/{f}").size)) for f in files]
    assert all(h.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for h in heads)
    ids = [x for h in heads for x in re.findall(rb"\r\nWARC-Record-ID: (\S+)", h)]
    assert len(ids) == len(set(ids)) == len(pages) + len(files)
    assert warc.archive(df.limit(0), fresh_dir(spark, "warc"))[1].count() == 0


def test_url_key():
    assert warc.url_key("HTTP://www.Example.com:80/A?b=C#d") == "com,example,www)/a?b=c"
    assert warc.url_key(None) == "-"


#: Pages that are wrapped in an element whose name or kind is boilerplate elsewhere; %s is the article.
WRAPPED = [
    '<div class="content has-sidebar">%s</div>', '<div class="page no-sidebar">%s</div>', '<div class="layout right-sidebar">%s<div class="sidebar"><p>{}</p></div></div>', '<div id="page-with-navbar"><div class="navbar">Home News</div>%s</div>',
    '<div class="has-sticky-header">%s</div>', '<form id="aspnetForm">%s<div class="footer">Rights</div></form>', '<main><fieldset>%s</fieldset></main>', '<form><div class="left-nav wrap"><form class="search"><p>{}</p></form>%s</div></form>',
    '<div class="paywall">%s</div><footer>{}</footer>', "<header>%s</header>",
]


def test_wrappers_keep_their_article(monkeypatch):
    article = "".join(f"<p>{LONG}{k}</p>" for k in range(3))
    want = "\n".join(f"{LONG}{k}" for k in range(3))
    pages = [f"<html><body>{w.replace('{}', LONG + 'no part of it')}</body></html>" % article for w in WRAPPED]
    assert [html_text.main_text(p) for p in pages] == [want] * len(pages)
    # The same elements beside an article that surges are boilerplate, and so are comments and adverts whatever they weigh.
    for w in WRAPPED[:6]:
        beside = w.replace("{}", "x") % f"<p>{LONG}no part of it</p>"
        assert html_text.main_text(f"<html><body><div>{article}</div>{beside}</body></html>") == want
    for name in ("comments", "advert", "cookie-notice", "related"):
        assert html_text.main_text(f"<p>Short.</p><div class={name}>{article}</div>") == "Short."
    # A form that isn't nearly all of the page isn't what the page is wrapped in.
    assert html_text.main_text(f"<p>{'short text ' * 3}</p><form><p>{LONG}</p></form>") == ("short text " * 3).strip()
    # Without windows there is nothing to say so, and each of these pages is lost.
    monkeypatch.setattr(html_text, "surges", lambda weights: True)
    assert sum(html_text.main_text(p) != want for p in pages) == len(pages)


def test_running_starts_past_six_digits(spark):
    numbers = [999_998, 999_999, 1_000_000, 1_000_001, 2_000_000, 5]
    rows = [(n, 10 * k + 1) for k, n in enumerate(numbers)]
    got = {r["number"]: r["first"] for r in common.running_starts(spark.createDataFrame(rows, "number long, n_tokens long"), "number", "n_tokens").collect()}
    assert got == {n: sum(t for m, t in rows if m < n) for n in numbers}
    names = [f"shard-{n:06d}-x.sst" for n in numbers[1:3]]
    assert sorted(names) != names  # which is why shards are ordered by number
