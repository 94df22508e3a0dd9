"""Catalog operators: page extraction, text functions, index, search and the rest, on small hand-made cases."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from showloom.functions import dates, html, text, urls, wiki
from showloom.operators import catalog, crawl, events, grammar, quality, search
from showloom.operators.index import Index
from showloom.plans import catalogue
from showloom.sources import tables


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    cases = {"5 Jan 99": "1999-01-05", "12 Sept 2001": "2001-09-12", "Mat 2004": "2004-05-01", "1999": "1999-01-01", "___ ____": None, "?? Sep 2001": "2001-09-01", "12 April 2001": None, "31 Feb 2001": "2001-02-31", "xx": None, None: None, "3 Mar 05": "2005-03-03", "1 Jan 999": "0999-01-01"}
    assert column(spark, cases, dates.date_to_iso) == [*cases.values()]


def test_text(spark):
    titles = {"The Office (2005 American TV series)": "the office", "Lost (2004-2010)": "lost", " A–B: C/D! ": "a b c d", "Show (anime)": "show", "X (film)": "x (film)", "Q (British children's series)": "q"}
    assert column(spark, titles, text.norm_title) == [*titles.values()]
    assert column(spark, ["Skins (british tv series)", "Lost (anime)", None], text.norm_query) == ["skins", "lost (anime)", ""]
    assert column(spark, ["Ünder the B-52s a", None], text.tokenize) == [["nder", "the", "b", "52s", "a"], []]
    assert column(spark, ["Under THE B-52s of x"], text.tokenize_for_vectors) == [["under", "52s"]]
    assert column(spark, ["a , b|c;; d", ""], text.genres) == ["a,b,c,d", ""]
    assert column(spark, ["x; y ;", None], text.roles) == [["x", "y"], ["cast"]]


SHOW = """<meta name="keywords" content="fun, &amp; games"/><div class="center titleblock" x><h2> <a href="/a">Tom &amp; Co</a></h2></div>
Start date: <a href="d">5 Jan 99</a><br> End date: ___ ____<br> Status: <a>Ended</a><br/> Network(s): <a href="n">ABC</a> (<a href="c">US</a>) / x<br>
Run time: 30/60 min<br> Genre(s): Drama, Comedy | War<br><div id="blurb">A <b>fine</b>  show.<br></div>
<div id="credits"><ul><li class='lihd'>Cast</li><li><a href="/p1"><strong>Ann Lee</strong></a> as Bo; Cy [1]</li><li>Thomas Smith</li></ul></div>
<div id="eplist"><pre>
 1. 1-1  5 Jan 99 <a href="/e1">One</a>
 2. 1-2  6 Jan 99 <a href="/e2">Two</a>
 3. 0-1  7 Jan 99 <a href="/s1">Special</a>
 4. 2-1  8 Jan 00 <a href="/e3">Three</a>
 5. 1-2  9 Jan 99 <a href="/e4">Two again</a>
</pre></div>"""
TABLE = """<div class="center titleblock"><h2><a>Other</a></h2></div><div id="eplist"><table><tr> <td class='epinfo right'>1.</td><td class='epinfo left pad'>3- 4&nbsp;</td><td class='epinfo right pad'>1 Feb 2010</td>
<td class='eptitle left'><a href="/x">Ep &eacute;</a></td></tr></table></div>"""


@pytest.fixture(scope="session")
def shows(spark):
    return html.extract(spark.createDataFrame([("u1", SHOW), ("u2", TABLE), ("u3", "<p>nothing</p>"), ("u4", None)], "url string, html string"))


def test_show_pages(spark, shows):
    one = {r["url"]: r for r in shows["shows"].collect()}
    assert set(one) == {"u1", "u2"}
    r = one["u1"]
    assert (r["title"], r["keywords"], r["date_start_iso"], r["date_end"], r["status"], r["network"], r["country"], r["runtime_minutes"]) == ("Tom & Co", "fun, & games", "1999-01-05", None, "Ended", "ABC", "US", "30-60")
    assert (r["genres"], r["description"], r["episode_count"], r["season_count"]) == ("Drama,Comedy,War", "A fine show.", 5, 2)
    got = [tuple(r) for r in shows["episodes"].filter("show_url = 'u1'").orderBy("episode_number_overall").select("season_number", "episode_number_in_season", "episode_title").collect()]
    assert got == [(1, 1, "One"), (1, 2, "Two again"), (2, 1, "Three"), (0, 1, "Special")]
    assert tuple(shows["episodes"].filter("show_url = 'u2'").first())[1:] == (3, 4, 1, "Ep é", "1 Feb 2010", "2010-02-01", "/x")
    assert sorted(tuple(r) for r in shows["credits"].drop("position").collect()) == [("u1", "Ann Lee", "Bo"), ("u1", "Ann Lee", "Cy"), ("u1", "Thomas Smith", "cast")]
    assert sorted(tuple(r) for r in shows["actors"].select("actor_name", F.coalesce("actor_url", F.lit(""))).collect()) == [("Ann Lee", "/p1"), ("Thomas Smith", "")]
    assert sorted(tuple(r) for r in shows["seasons"].filter("show_url = 'u1'").collect()) == [("u1", 1, 2), ("u1", 2, 1)]
    pages = spark.createDataFrame([("u1", SHOW), ("u3", "x"), ("u4", None)], "url string, html string")
    assert [r["status"] for r in html.status(pages).orderBy("url").collect()] == ["success", "no_data", "error: no content"]


WIKI = "{{short}}{{Infobox television\n| name = X\n| alt_name = \n| alt_name = Y<ref>r</ref>\n| first_aired = {{Start date|2004|9|22}}\n| starring = {{plainlist|\n* [[A|Ann]]\n* Bob\n}}\n| company = C1\n}}\n'''Lost''' is a [[drama|series]] about people. It ran. It ended. It is over now.\n\n== Plot ==\nMore {{x{{y}}}} text.\n[[Category: Drama|k]]\n[[Category:Drama]] [[Category:2004]]"


def test_wikitext(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    info = one(wiki.infobox, WIKI)
    assert (info["alt_name"], info["starring"], info["name"], info["_infobox_type"]) == ("Y", "Ann, Bob", "X", "television")
    assert one(wiki.infobox, "no box") == {} and one(wiki.infobox, None) == {} and one(wiki.infobox, "{{infobox television\n|a=1\n|b=2")["b"] == "2"
    assert one(wiki.without_templates, "a {{b {{c}} d}} e }} f {{{x}}} g") == "a  e }} f } g" and one(wiki.without_templates, "a {{b") == "a "
    pages = spark.createDataFrame([(1, "Lost (2004 TV series)", WIKI), (2, "r", "#REDIRECT [[x]]"), (3, "n", None), (4, "o", "{{Infobox film}}")], "page_id long, title string, raw_text string")
    row = tables.wiki_shows(pages).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["norm_title"], r["page_start_year"], r["alt_title"], r["production_company"], r["categories"]) == ("lost", 2004, "Y", "C1", "Drama, 2004")
    assert r["description"] == "Lost is a series about people. It ran. It ended." and len(r) == 42
    assert tables.wiki_shows(pages, ["dram"]).count() == 1 and tables.wiki_shows(pages, ["news"]).count() == 0


def test_join_and_documents(spark, shows):
    wiki_rows = tables.wiki_shows(spark.createDataFrame([(1, "Tom & Co (TV series)", WIKI.replace("2004|9", "1999|9")), (2, "Alone", WIKI)], "page_id long, title string, raw_text string"))
    joined = catalog.join_wiki(shows["shows"], wiki_rows)
    assert len(joined.columns) == 59 and joined.count() == 3
    assert joined.filter("url is not null and wiki_page_id is not null").count() == 1
    docs = {r["url"]: r for r in catalog.show_docs(shows["shows"], shows["episodes"], shows["credits"]).collect()}
    assert docs["u1"]["episodes"].split("\n")[1] == "Two again (1999-01-09)" and docs["u1"]["cast"] == "Ann Lee, Thomas Smith" and docs["u1"]["characters"] == "Bo, Cy, cast"
    found = {r["show_name"]: r for r in catalog.search_docs(joined, shows["episodes"], shows["credits"]).collect()}
    assert found["Tom & Co"]["genres_exact"] == ["drama", "comedy", "war"] and found["Tom & Co"]["start_year"] == 1999 and found["Other"]["cast_all"] == "" and "Ann, Bob" in found["Tom & Co"]["content_all"]


def test_cosine_by_hand(spark):
    docs = spark.createDataFrame([(0, "red red blue", "x"), (1, "blue", "y"), (2, "green", "z"), (3, "", "e")], "doc_id long, body string, title string")
    index = Index.build(docs, {"body": 1.0}, title="title")
    hit = search.cosine(index, "red").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in hit] == [(0, 0.912202)]
    boosted = search.cosine(Index.build(docs.withColumn("title", F.lit("The RED one")), {"body": 1.0}, title="title"), "red").first()
    assert round(boosted["score"], 6) == 1.185862
    assert not search.cosine(index, "").collect() and not search.cosine(index, "nothing").collect()
    with pytest.raises(ValueError):
        index.idf("other")
    weighted = Index.build(spark.createDataFrame([(1, "a a a a a")], "doc_id long, t string"), {"t": 2.1}).postings.first()
    assert weighted["tf"] == 10


def test_index_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common", f"t{i}") for i in range(60)], "doc_id long, body string, title string")
    index = Index.build(docs, {"body": 1.0}, title="title")
    index.save(str(tmp_path / "i"))
    saved = Index.load(spark, str(tmp_path / "i"))
    for mode in ("classic", "smooth", "prob", "invdf"):
        rounded = lambda i, m=mode: [(r["doc_id"], round(r["score"], 9)) for r in search.cosine(i, "w1 w2 common", m).collect()]
        assert rounded(saved) == rounded(index)


def test_mini_language(spark):
    p = search.parse('lost country:US genre:"talk show" year>=1990 year<=x  year<=2000 (2004)')
    assert p.text == "lost (2004)" and p.filters == [("country", "us"), ("genre", "talk show"), ("from", 1990), ("to", 2000)]
    docs = spark.createDataFrame([(1, "lost island", "US", ["drama"], 1995), (2, "lost city", "UK", ["drama"], None), (3, "island", "US", ["news"], 1980)], "doc_id long, content string, country string, genres_exact array<string>, start_year int")
    index = search.FieldIndex.build(docs, ["content"])
    ids = lambda q: [r["doc_id"] for r in search.bm25(index, docs, q).collect()]
    assert ids("lost") == [1, 2] and ids("lost country:us") == [1] and ids("year>=1900") == [1, 3] and ids("") == [1, 2, 3] and ids("island genre:news") == [3]
    score = search.bm25(index, docs, "city").first()["score"]
    assert abs(score - math.log(1 + 2.5 / 1.5) / (1 + 1.2 * (0.25 + 0.75 * 2 / (5 / 3)))) < 1e-12
    assert search.bm25(index, docs, "city", boosts={"content": 2.0}).first()["score"] == pytest.approx(2 * score)


def test_grammar():
    def shape(node):
        return [("+" if must else "") + (x.text + f"^{x.boost:g}" * (x.boost != 1) + f"~{x.edits}" * bool(x.edits) if isinstance(x, grammar.Leaf) else str(shape(x))) for must, x in node.clauses]

    assert shape(grammar.parse('a +b "c d"^3 e~1 f~9')) == ["a", "+b", "c d^3", "e~1", "f~2"]
    assert shape(grammar.parse("a b && c || d")) == ["a", "+b", "+c", "d"]
    assert shape(grammar.parse("(a +(b c^2))^3 c++ r&b")) == ["['a^3', \"+['b^3', 'c^6']\"]", "c++", "r&b"]
    assert [x.kind for x in grammar.parse(r'x* a\*b a\\* "q"').leaves()] == ["wildcard", "word", "wildcard", "phrase"]
    assert grammar.wildcard("ab*") == ("ab", None) and re.match(grammar.wildcard("a*b")[1].replace(r"\x{61}", "a").replace(r"\x{62}", "b"), "axxb")
    assert grammar.swapped("abcd", 1) == ["abdc", "acbd", "bacd"] and grammar.swapped("abcd", 2) == ["badc"] and grammar.swapped("a", 1) == []
    for bad in ('"open', "(a", "a)", "()", "&& a", "a &&", "+", "^2", "*a", "(a)~", "[a to b]", "a ^2^3"):
        with pytest.raises(ValueError):
            grammar.parse(bad)


def test_bm25_grammar(spark, tmp_path):
    rows = [(1, "red green blue"), (2, "green red"), (3, "red blue green red green"), (4, "rde"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    built = search.FieldIndex.build(docs, ["content"])
    built.save(str(tmp_path))
    for index in (built, search.FieldIndex.load(spark, str(tmp_path))):
        ids = lambda q, index=index: sorted(r["doc_id"] for r in search.bm25(index, docs, q).collect())
        assert ids('"red green"') == [1, 3] and ids('"green red green"') == [3] and ids('"red red"') == []
        assert ids("gre*") == [1, 2, 3] and ids("b*e") == [1, 3] and ids("red~") == [1, 2, 3, 4] and ids("rde~1") == [1, 2, 3, 4] and ids("dre~0") == []
        assert ids("+red +blue") == [1, 3] and ids("red && (blue || rde)") == [1, 3] and ids("+blue rde") == [1, 3] and ids("rde blue") == [1, 3, 4]
        assert ids("%") == [] and ids("absent") == [] and ids('"%" red') == [1, 2, 3]
        assert [r["score"] for r in search.bm25(index, docs, "r*^3").collect()] == [3.0] * 4
        # "red green" is once in each: document 3 has it at its end.
        scores = {r["doc_id"]: r["score"] for r in search.bm25(index, docs, '"red green"').collect()}
        idf, tf = math.log(1 + (4 - 3 + 0.5) / (3 + 0.5)), {1: (1, 3), 3: (1, 5)}
        assert scores == pytest.approx({i: 2 * idf * n / (n + 1.2 * (0.25 + 0.75 * dl / 2.75)) for i, (n, dl) in tf.items()})


def test_quality(spark, shows):
    found = {(r["table"], r["url"], r["rule"]) for r in quality.validate(shows).collect()}
    assert ("shows", "u1", "missing or invalid end date") in found and ("shows", "u2", "without credits") in found and ("shows", "u2", "missing status") in found
    assert not any(t == "episodes" for t, _, _ in found)
    stray = {**shows, "credits": spark.createDataFrame([("zz", None, "r")], "show_url string, actor_name string, role string")}
    found = {(r["table"], r["url"], r["rule"]) for r in quality.validate(stray).collect()}
    assert {("credits", "zz", "unknown show"), ("credits", "zz", "missing actor"), ("shows", "u1", "without credits")} <= found
    assert all(r["table"] == "shows" for r in quality.validate({"shows": shows["shows"]}).collect())
    assert len(quality.show_rules()) == 14


def test_link_graph_bfs_follows_all_links(spark, tmp_path):
    chain = {f"/p{k}": [f"/p{k}", f"/p{k + 1}"] for k in range(7)} | {"/p7": ["/p7", "/p2", "/p0"], "/z": ["/z", "/p1"]}
    pages = [(i, f"u{i}", "".join(f'<a href="{x}">x</a>' for x in found)) for i, found in enumerate(chain.values())]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    level, todo = {"/p0": 0}, ["/p0"]
    for at in todo:
        for x in chain[at]:
            if x not in level:
                level[x] = level[at] + 1
                todo.append(x)
    got = catalogue.QUERIES["link_graph_bfs"](spark, str(tmp_path)).collect()
    assert sorted((r["url"], r["level"]) for r in got) == sorted((catalogue.SITE[:-1] + x, k) for x, k in level.items()) and max(level.values()) == 7


def test_urls_and_crawl(spark):
    root = "http://s.com/"
    assert column(spark, ["/a", "b", "//t.com/x", "https://q.com", "", "http://s.com/z#f"], lambda c: urls.resolve(c, root)) == ["http://s.com/a", "http://s.com/b", "http://t.com/x", "https://q.com", root, "http://s.com/z#f"]
    assert column(spark, ["../a/./b"], lambda c: urls.resolve_exactly(c, root)) == ["http://s.com/a/b"]
    assert column(spark, ["http://s.com", "http://s.com/x/", "http://s.com/x.php?q=1", "http://s.com/y?q=1#f"], urls.store_path) == ["data/index.html", "data/x/index.html", "data/x__q_" + __import__("hashlib").sha1(b"q=1").hexdigest()[:10] + ".php", "data/y__q_" + __import__("hashlib").sha1(b"q=1").hexdigest()[:10] + ".html"]
    pages = spark.createDataFrame([(root, "<a href='/a'><a HREF=\"b\"><a href='mailto:x'><a href='http://other.com/'>"), (root + "a", "<a href='/c'><a href='/'>"), (root + "b", None), (root + "c", "<a href='/private/d'>")], "url string, html string")
    disallowed, permitted = urls.robots_rules("User-agent: *\nDisallow: /private # no\nAllow: /private/ok")
    got = {r["url"]: (r["level"], r["fetched"], r["n_links"]) for r in crawl.crawl(pages, spark.createDataFrame([(root,)], "url string"), root, allowed=urls.allowed(F.col("dst"), disallowed, permitted)).collect()}
    assert got == {root: (0, True, 2), root + "a": (1, True, 2), root + "b": (1, False, 0), root + "c": (2, True, 0)}


def test_events(spark):
    lines = spark.createDataFrame([('2024 - INFO - {"event": "page_crawled", "links_found": 3, "response_time_s": 2.0}',), ('{"event": "crawl_error", "url": "u"}',), ("noise",)], "value string")
    assert tuple(events.crawl_stats(events.parse(lines)).first()) == (1, 3, 1, 2.0, 0.5)


def test_files(spark, tmp_path):
    rows = [("u", 'say "hi"\tx', "line\nbreak"), ("v", None, "z" * 5000)]
    tables.write_tsv(spark.createDataFrame(rows, "a string, b string, c string"), str(tmp_path / "t"))
    got = sorted(tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "t"), "a string, b string, c string").collect())
    assert got == [("u", 'say "hi"\tx', "line\nbreak"), ("v", None, "z" * 4000)]
    (tmp_path / "k.txt").write_text("# c\n\ndrama \nnews\n")
    assert tables.read_keywords(spark, str(tmp_path / "k.txt")) == ["drama", "news"]


def test_dump_chunks_are_taken_once(spark, tmp_path):
    from showloom.streaming.ingest import ingest_dump

    chunk = lambda i: f"<mediawiki><page><title>Lost</title><id>{i}</id><revision><id>9</id><text bytes='3'>{WIKI.replace('<', '&lt;')}</text></revision></page></mediawiki>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(chunk(1))
    out = [str(tmp_path / x) for x in ("in", "out", "ck")]
    ingest_dump(spark, *out)
    ingest_dump(spark, *out)
    assert [r["page_id"] for r in spark.read.parquet(out[1]).collect()] == [1]
    (tmp_path / "in/b.xml").write_text(chunk(2))
    ingest_dump(spark, *out)
    assert sorted(r["page_id"] for r in spark.read.parquet(out[1]).collect()) == [1, 2]
    assert tables.read_dump(spark, out[0]).count() == 2


def test_links_resolve_as_by_urljoin(spark):
    from urllib.parse import urljoin

    root = "http://s.com/"
    links = ["a", "./a", "../a", "a/..", "a/.", "a/../b/./c", "/x/../../y", "..a/b..", "a/b/../../..", "/", "", "?q=../x", "#./x", "a?x=./b#../c", "http://t.com/a/../b", "//t.com/../b", "mailto:x@y.z", "a//b/../c", "/a/./", "..", "."]
    assert column(spark, links, lambda c: urls.resolve_exactly(c, root)) == [urljoin(root, x).replace("http://s.com?", "http://s.com/?") for x in links]


def test_fetch(spark):
    def get(url):
        if url == "down":
            raise ConnectionError(url)
        return {"ok": (200, "text/html; charset=utf-8", "<p>é</p>"), "gone": (404, "text/html", "x"), "image": (200, "image/png", "x")}[url]

    got = crawl.fetch(spark.createDataFrame([("ok",), ("gone",), ("image",), ("down",), (None,)], "url string"), get).collect()
    assert [tuple(r) for r in got] == [("ok", "<p>é</p>"), ("gone", None), ("image", None), ("down", None), (None, None)]


def test_batch_cosine_leaves_nothing_out(spark):
    import random

    random.seed(3)
    words = ["the"] * 30 + ["of"] * 20 + [f"w{i}" for i in range(60)]
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(1, 40))) for _ in range(300)]
    queries = ["the of w1 w2", "the", "w3 w3 of", "nothing", "the of", "w5 w6 w7 w8 the of of"]
    built = Index.build(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "doc_id long, body string, title string"), {"body": 1.0})
    counts, n = [Counter(t.split()) for t in texts], len(texts)
    df = Counter(t for c in counts for t in c)
    for mode, idf in (("smooth", lambda d: math.log((n + 1) / (d + 1)) + 1), ("prob", lambda d: math.log((n - d + 0.5) / (d + 0.5)))):
        weights = lambda c: {t: (1 + math.log(k)) * idf(df[t]) for t, k in c.items() if t in df}
        size = lambda w: math.sqrt(sum(x * x for x in w.values()))
        own = [weights(c) for c in counts]
        many = search.cosine_many(built, spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"), mode, k=4).collect()
        for i, q in enumerate(queries):
            w = weights(Counter(q.split()))
            scores = [(-round(sum(w[t] * x[t] for t in w if t in x) / (size(w) * size(x)), 12), d) for d, x in enumerate(own) if any(t in x for t in w)]
            got = [(r["doc_id"], round(r["score"], 9)) for r in sorted(many, key=lambda r: r["rank"]) if r["query_id"] == i]
            assert got == [(d, round(-v, 9)) for v, d in sorted(scores)[:4]], (mode, q)


def test_numbers_without_gaps(spark):
    from showloom.operators.numbering import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = [(r["k"], r["n"]) for r in numbered(rows, "n", "k").orderBy("k").collect()]
    assert [n for _, n in got] == list(range(1000)) and numbered(rows.limit(0), "n", "k").count() == 0
