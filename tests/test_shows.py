"""Pages of shows are made and parsed in many tasks, once, and no more of them than a table needs."""

import contextlib
import datetime
import io

from showloom.functions import html
from showloom.plans import catalogue, shows


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_pages_of_small_tables_are_made_in_many_tasks(spark, sf):
    assert shows.show_pages(spark, sf).rdd.getNumPartitions() >= 4


def test_actors_look_for_no_other_fields(spark, sf):
    pages = spark.createDataFrame([("u", "x")], "url string, html string")
    found = plan(html.extract(pages, wanted=("cast",))["actors"])
    assert "credits" in found and "Genre" not in found and "eplist" not in found


def test_the_show_table_parses_pages_once(spark, sf):
    pages = spark.createDataFrame([("u", "x")], "url string, html string")
    found = plan(html.extract(pages, wanted=("shows",))["shows"])
    assert found.count("Exchange hashpartitioning(url") == 1 and "Join" not in found


def test_rows_with_the_mark_are_parsed_group_by_group(spark):
    page = '<div class="center titleblock"><h2><a href="/a">T</a></h2></div><div id="credits"><li><a href="/p\x01q">N\x01M</a> as R</li><li>Plain as S</li></div>'
    got = html.cast(html.parse(spark.createDataFrame([("u", page)], "url string, html string"))).orderBy("at").collect()
    assert [tuple(r) for r in got] == [("u", 0, "N\x01M", "/p\x01q", ["R"]), ("u", 1, "Plain", None, ["S"])]


def test_counts_of_pages_with_one_url_are_over_all_of_them(spark):
    head = '<div class="center titleblock"><h2><a href="/a">T</a></h2></div><div id="eplist"><pre>\n'
    row = ' 1. {}-1  1 Jan 01 <a href="/e">E</a>\n'
    pages = [("u", head + row.format(1) + row.format(0) + "</pre></div>"), ("u", head + row.format(2) + "</pre></div>"), ("v", head + row.format(3) + "</pre></div>"), (None, head + row.format(3) + "</pre></div>")]
    got = html.shows(html.parse(spark.createDataFrame(pages, "url string, html string")))
    assert sorted(tuple(r) for r in got.fillna("").select("url", "episode_count", "season_count").collect()) == [("", 0, 0), ("u", 3, 2), ("u", 3, 2), ("v", 1, 1)]


def test_joined_shows_keep_no_parsed_pages(spark, sf):
    assert "Scan ExistingRDD" not in plan(catalogue.QUERIES["joined_shows_wiki"](spark, sf))


def test_rows_that_were_taken_apart_once_give_the_same_tables(spark):
    head = '<div class="center titleblock"><h2><a href="/a">T &amp; U</a></h2></div>'
    page = head + '<div id="credits"><li><a href="/p">N &lt;M</a> as R; S &amp; T</li><li>Plain</li></div><div id="eplist"><pre>\n 1. 1-1  1 Jan 01 <a href="/e">E &amp;amp; F</a>\n 2. 0-2  2 MAY 1999 <a href="/g">G</a>\n</pre></div> 9. 9-9  1 Jan 01 <a href="/z">Z</a>\n'
    parsed = html.parse(spark.createDataFrame([("u", page)], "url string, html string"))
    kept = html.apart(parsed)
    assert kept.schema["cast_rows"].dataType != parsed.schema["cast_rows"].dataType
    want, got = html.tables_of(parsed), html.tables_of(kept)
    for t in want:
        assert sorted(map(repr, got[t].collect())) == sorted(map(repr, want[t].collect())), t
    assert sorted(tuple(r)[1:] for r in got["episodes"].collect()) == [(0, 2, 2, "G", "2 MAY 1999", "1999-05-02", "/g"), (1, 1, 1, "E &amp; F", "1 Jan 01", "2001-01-01", "/e")]


def test_dates_and_references_by_the_quick_way(spark):
    dates = {"1 Jan 2001": "2001-01-01", "?2 sept 99_ x": "1999-09-02", "MAY 29": "2029-05-01", "1998 on": "1998-01-01", "1 Foo 2001": None, "Foo 2001": None, "x": None, "": None, "12 Mar 123": "0123-03-12", "3 Jul 2004\x01a": "2004-07-03", "1\x01jan\x012001\x01": None}
    texts = {"a &amp; b": "a & b", "&amp;lt;": "&lt;", "&&lt;&": "&<&", "&lt &amp;": "< &", "&copy;&quot;": '©"', "&ampx;": "&x;", "& ; &;": "& ; &;"}
    rows = spark.createDataFrame([(k, True, v) for k, v in dates.items()] + [(k, False, v) for k, v in texts.items()], "t string, d boolean, want string")
    got = rows.select("t", "want", html.F.when(html.F.col("d"), html.date_to_iso(html.F.col("t"))).otherwise(html.unescape(html.F.col("t"))).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got]


def test_tables_by_url_shuffle_nothing_after_the_pages(spark, sf):
    for name in ("show_episodes", "show_table", "show_seasons"):
        found = plan(catalogue.QUERIES[name](spark, sf))
        assert found.count("Exchange hashpartitioning(") == 2 and "Exchange hashpartitioning(url" not in found, name


def test_written_pages_are_dealt_to_as_many_parts_as_they_need(spark, monkeypatch, tmp_path):
    html.parse(spark.createDataFrame([(f"u{i}", TITLED) for i in range(30)], "url string, html string")).write.parquet(str(tmp_path / "p"))
    parsed = spark.read.parquet(str(tmp_path / "p"))
    assert html.parts_for(parsed) is None
    monkeypatch.setattr(html, "PAGES", 3)
    tables = html.tables_of(parsed, html.parts_for(parsed))
    for name in ("episodes", "shows"):
        found = plan(tables[name])
        assert found.count("Exchange hashpartitioning(") == found.count("Exchange hashpartitioning(url") == 1 and ", 10), REPARTITION" in found, name
    assert tables["episodes"].count() == 30


TITLED = '<div class="center titleblock"><h2><a href="/a">T</a></h2></div><div id="eplist"><pre>\n 1. 1-1  1 Jan 01 <a href="/e">E</a>\n</pre></div>'


def test_pages_whose_url_is_one_have_their_own_lines(spark, tmp_path):
    day, keys = datetime.datetime(2001, 1, 1), [123456780, 123456781, 5, 6]
    spark.createDataFrame([(k, day, "F", "x") for k in keys], "o_orderkey long, o_orderdate timestamp, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(123456780, 1, 10), (123456780, 2, 11), (123456781, 1, 12), (6, 1, 13), (None, 1, 14)]
    spark.createDataFrame([(k, n, p, 1, 1.0, day, "N", "O") for k, n, p in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    for deal in (shows.address, html.F.col):
        got = shows.show_pages(spark, str(tmp_path), deal).select("url", html.F.regexp_extract_all("html", html.F.lit("/ep/([0-9]+)"), html.F.lit(1)).alias("parts"))
        assert sorted((r["url"][-9:], r["parts"]) for r in got.collect()) == [("00000005/", []), ("00000006/", ["13"]), ("12345678/", ["10", "11"]), ("12345678/", ["12"])]


def test_episodes_of_pages_with_one_url_are_of_one_show(spark):
    rows = [("u", 0, 0, 1, "s"), ("u", 1, 2, 1, "a"), ("u", 2, 1, 5, "b"), ("u", 3, 2, 1, "c"), ("u", 4, 2, 0, "d"), ("v", 0, 1, 1, "e"), ("u", 5, None, 1, "x"), (None, 0, 1, 1, "y")]
    made = spark.createDataFrame([(*r, "", "", "") for r in rows], "url string, at int, season_number int, episode_number_in_season int, episode_title string, airdate string, airdate_iso string, episode_url string")
    for parts in (None, 3):
        got = html.episodes(made, parts).select("show_url", "episode_number_overall", "season_number", "episode_number_in_season", "episode_title").collect()
        assert sorted(map(tuple, got)) == [("u", 1, 2, 1, "c"), ("u", 2, 2, 0, "d"), ("u", 3, 1, 5, "b"), ("u", 4, 0, 1, "s"), ("v", 1, 1, 1, "e")]


def test_pages_have_more_parts_the_more_line_items_there_are(spark, sf, monkeypatch):
    monkeypatch.setattr(shows, "LINES", 200)
    found = plan(catalogue.QUERIES["extraction_outcomes"](spark, sf))
    assert found.count(f", {-(-spark.read.parquet(f'{sf}/lineitem.parquet').count() // 200)}), REPARTITION_BY_NUM") == 2


def test_parts_are_no_more_than_are_written_straight_to_files_until_they_are_large(spark, sf, monkeypatch):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    # There are lines for three hundred parts; past two hundred a task that deals them sorts them in memory, and spills.
    monkeypatch.setattr(shows, "LINES", -(-n // 300))
    assert plan(catalogue.QUERIES["extraction_outcomes"](spark, sf)).count(", 200), REPARTITION_BY_NUM") == 2
    monkeypatch.setattr(shows, "MOST", -(-n // 250))
    assert plan(catalogue.QUERIES["extraction_outcomes"](spark, sf)).count(f", {-(-n // shows.MOST)}), REPARTITION_BY_NUM") == 2


def odd_pages(spark):
    """Pages of one URL, without a title, without a URL; with marks, references and white space in rows."""
    head = '<div class="center titleblock"><h2><a href="/a">T{}</a></h2></div>'
    people = '<div id="credits"><ul><li class=\'lihd\'>Cast</li>{}</ul></div>'
    row = ' 1. {}  1 Jan 01 <a href="/e">{}</a>\n'
    listed = lambda *rows: '<div id="eplist"><pre>\n' + "".join(row.format(*r) for r in rows) + "</pre></div>\n 9. 9-9  1 Jan 01 <a href=\"/z\">Z</a>\n"
    cast = people.format('<li><a href="/p">N &lt;M</a> as R &amp;amp; Q;  S</li><li> Plain</li><li>Plain as S</li><li>None as ;</li><li>&amp;copy; X as A &copy B</li>')
    return spark.createDataFrame(
        [
            ("u", head.format(1) + cast + listed(("2-1", "a"), ("1-5", "b  b"), ("2-1", "c &amp; d"), ("2 - 0", "&copy;e"), ("0-1", "s"), ("99999999999-1", "x"), ("1-99999999999", "y"))),
            ("u", head.format(2) + listed(*[("99999999999-1", "x")] * 8, ("3-1", "f"))),
            ("m", head.format(3) + people.format("<li>A\x01B as C\x02D</li>") + listed(("1-1", "g\x01h  i"))),
            ("untitled", cast + listed(("1-1", "z"))),
            ("blank", head.format(" ").replace("T ", " ") + listed(("1-1", "z"))),
            ("empty", head.format(4)),
            ("gone", None),
            (None, head.format(5) + cast + listed(("1-1", "z"), ("2-2", "z"))),
        ],
        "url string, html string",
    )


def sorted_rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_pages_gone_through_once_give_the_five_tables_and_documents(spark):
    from showloom.operators import catalog

    pages = odd_pages(spark)
    want, rows = html.tables_of(html.parse(pages)), html.together(pages)
    got = html.tables_together(rows.checkpoint())
    for t in want:
        assert sorted_rows(got[t].select(*want[t].columns)) == sorted_rows(want[t]), t
    assert sorted_rows(catalog.page_docs(rows)) == sorted_rows(catalog.show_docs(want["shows"], want["episodes"], want["credits"]))
    wiki = spark.createDataFrame([("p", "T1", "t1", None, *[""] * len(catalog.INFO), "d", "c")], ", ".join(f"{c} {'int' if c == 'page_start_year' else 'string'}" for c in catalog.WIKI))
    docs = catalog.index_fields(catalog.join_wiki(catalog.with_texts(rows), wiki, 3))
    assert sorted_rows(docs) == sorted_rows(catalog.search_docs(catalog.join_wiki(want["shows"], wiki), want["episodes"], want["credits"]))
    titles = {r["show_name"]: r["episode_titles"] for r in docs.collect() if r["url"] == "u"}
    assert titles["T1"] == titles["T2"] and "c & d" in titles["T1"] and " \nb b" in titles["T1"]


def test_documents_go_through_pages_once_and_write_nothing(spark, sf):
    found = plan(catalogue.QUERIES["show_documents"](spark, sf))
    assert found.count("Exchange hashpartitioning(") == 2 and "Join" in found and found.count("Join") == 1 and "parsed-" not in found
    assert found.count("No title") == 1  # a page is made once, not once more for a filter
    # The two sides of the pages' join are sorted, and nothing after it.
    assert found.count("+- Sort") + found.count(":- Sort") == 3


def test_the_five_tables_are_written_of_pages_gone_through_once(spark, tmp_path, monkeypatch):
    from showloom.sources import tables

    seen = {}
    monkeypatch.setattr(tables, "write_tsv", lambda df, path: seen.update({path.rsplit("/")[-1]: df._jdf.queryExecution().toString()}))
    tables.write_tables(odd_pages(spark), str(tmp_path / "t"))
    assert sorted(seen) == ["actors", "credits", "episodes", "seasons", "shows"]
    assert [t for t, p in sorted(seen.items()) if "Exchange" in p] == ["actors"]


def test_encyclopedia_pages_are_made_in_many_tasks_for_the_join(spark, sf):
    parts = shows.parts_for(spark, spark.read.parquet(f"{sf}/lineitem.parquet").count())
    for name in ("search_documents", "joined_shows_wiki"):
        assert plan(catalogue.QUERIES[name](spark, sf)).count(f", {parts}), REPARTITION_BY_NUM") == 3, name
