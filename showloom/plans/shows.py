"""Queries over show pages, encyclopedia pages and their tables, made of the driver's orders and line items."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from showloom.functions import html
from showloom.operators import catalog, quality
from showloom.plans.shared import fresh, query, table
from showloom.sources import tables
from showloom.streaming.ingest import ingest_chunks, ingest_new, read_manifest

SITE = "http://site.example/shows/"


#: Line items of a partition on average: at most, while partitions are few enough to be written straight to files; and at
#: most in any case.
LINES, MOST = 200_000, 1_200_000


def parts_for(spark: SparkSession, lines: int) -> int:
    """How many parts pages of so many line items are dealt to.

    Up to a number of parts (200 unless the session has another) a task that deals rows writes each to its part's file. With
    more it sorts them in memory, the more the larger its split, and spills; so past it parts grow first, and their number
    only once they are as large as a task can sort. A number that is given isn't made less, so that pages of a small table
    aren't made and parsed in one task.
    """
    given = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    straight = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(given, min(math.ceil(lines / LINES), straight), math.ceil(lines / MOST))


def address(key: str) -> Column:
    """The URL of an order's page. Keys of over eight digits are cut, so that some pages have one URL."""
    return F.concat(F.lit(SITE), F.lpad(F.col(key).cast("string"), 8, "0"), F.lit("/"))


def lines_of(spark: SparkSession, sf_dir: str, parts: int, deal: Callable[[str], Column]) -> DataFrame:
    """l_place, lines: the line items of a place's orders in their order, dealt to parts by the place that deal makes of the
    order's key.

    Columns are shuffled as they are, and the list is a window's, whose rows are sorted once; a grouping would sort the
    lists again. The place is made of the key on both sides of the shuffle, so it isn't shuffled, and texts are made later,
    in the task that reads them.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus")
    order = Window.partitionBy("l_place").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus").repartition(parts, deal("l_orderkey")).withColumn("l_place", deal("l_orderkey"))
    return rows.select("l_place", F.collect_list(line).over(whole).alias("lines"), F.row_number().over(order).alias("k")).filter("k = 1").drop("k")


def show_pages(spark: SparkSession, sf_dir: str, deal: Callable[[str], Column] = address) -> DataFrame:
    """url, html: a show's page for each order, its line items as episodes (two layouts) and cast.

    Pages are dealt by URL, so that tables which are made by URL shuffle nothing more; F.col deals them by the order's key,
    which is quicker where nothing goes by URL. Every seventh has no title, every seventeenth isn't stored; seasons and numbers repeat, season 0 are specials.
    """

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    day = lambda c, p: F.date_format(c, p)

    def listed(form) -> Column:
        """The texts of an order's lines, by a form of a line and its place, joined."""
        return F.array_join(F.transform(own, lambda x, i: form(x, (i + 1).cast("string"))), "")

    number = lambda x: text((x["l_linenumber"] % 3).cast("string"), "-", (1 + x["l_partkey"] % 3).cast("string"))
    link = lambda x: text("<a href=\"/ep/", x["l_partkey"].cast("string"), "\">Part ", x["l_partkey"].cast("string"), " &amp; ", x["l_returnflag"], "</a>")
    cell = lambda x, k: text("<tr><td class='epinfo right'>", k, ".</td><td class='epinfo left pad'>", number(x), "&nbsp;</td><td class='epinfo right pad'>", day(x["l_shipdate"], "d MMM yyyy"), "</td><td class='eptitle left'>", link(x), "</td></tr>\n")
    row = lambda x, k: text(" ", k, ". ", number(x), "  ", day(x["l_shipdate"], "d MMM yy"), " ", link(x), "\n")
    supplier = lambda x: x["l_suppkey"].cast("string")
    person = lambda x, _: F.when(x["l_suppkey"] % 4 == 0, text("<li>Extra ", supplier(x), "</li>")).otherwise(text("<li><a href=\"/p/", supplier(x), "/", x["l_orderkey"].cast("string"), "\"><strong>Person ", supplier(x), " ", x["l_returnflag"], "</strong></a> as Role ", x["l_linestatus"], "; Lead &amp; Co [1]</li>"))
    parts = parts_for(spark, table(spark, sf_dir, "lineitem").count())
    of = lines_of(spark, sf_dir, parts, deal)
    key = F.col("o_orderkey")
    # Orders of one place have their lines in one list, of which a page takes its own.
    own = F.filter(F.coalesce("lines", F.array().cast(dict(of.dtypes)["lines"])), lambda x: x["l_orderkey"] == key)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority").repartition(parts, deal("o_orderkey")).withColumn("o_place", deal("o_orderkey"))
    orders = orders.join(of.hint("merge"), F.col("o_place") == F.col("l_place"), "left")
    start, end = day("o_orderdate", "d MMM yyyy"), F.when(key % 3 == 0, "___ ____").otherwise(day("o_orderdate", "MMM yyyy"))
    status = F.when(F.col("o_orderstatus") == "F", "Ended").when(F.col("o_orderstatus") == "O", "Current Show").otherwise("On Hiatus")
    network = F.when(key % 5 == 0, "").otherwise(text("<a href=\"n\">Net ", (key % 4).cast("string"), "</a> "))
    run = F.when(key % 4 == 0, "30/60 min").when(key % 4 == 1, "45 min").otherwise("20-25")
    page = text(
        text("<meta name=\"keywords\" content=\"kw", (key % 10).cast("string"), ", &amp; ", F.col("o_orderpriority"), "\"/>"),
        F.when(key % 7 != 0, text("<div class=\"center titleblock\" x><h2> <a href=\"/a\">Show ", key.cast("string"), " &amp; Co</a></h2></div>\n")).otherwise("<h2>No title</h2>\n"),
        text("Start date: <a href=\"d\">", start, "</a><br> End date: ", end, "<br>\n"),
        F.when(key % 13 != 0, text("Status: <a>", status, "</a><br/>\n")).otherwise(""),
        text("Network(s): ", network, "(<a href=\"c\">", F.when(key % 2 == 0, "US").otherwise("UK"), "</a>) / x<br>\n"),
        F.when(key % 4 != 3, text("Run time: ", run, "<br>\n")).otherwise(""),
        text("Genre(s): ", F.when(key % 3 == 0, "Drama, Comedy | War").otherwise("News"), "<br>\n<div id=\"blurb\">A <b>", F.col("o_orderpriority"), "</b>  show.<br></div>\n"),
        text("<div id=\"credits\"><ul><li class='lihd'>Cast</li>", listed(person), "</ul></div>\n"),
        F.when(key % 11 == 0, listed(cell)).when(key % 2 == 0, text("<div id=\"eplist\"><table>", listed(cell), "</table></div>")).otherwise(text("<div id=\"eplist\"><pre>\n", listed(row), "</pre></div>")),
    )
    # The place itself, by which rows are sorted, so that what goes by URL isn't sorted again.
    url = F.col("o_place") if deal is address else address("o_orderkey")
    return orders.select(url.alias("url"), F.when(key % 17 != 0, page).alias("html"))


#: The same in SQL: shows, their line items by place, episodes and cast.
BASE = (
    f"sh AS (SELECT *, o_orderkey AS key, '{SITE}' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '/' AS url FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 17 <> 0), "
    "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem), "
    "rows AS (SELECT url, k, CAST(l_linenumber % 3 AS INTEGER) AS s, CAST(1 + l_partkey % 3 AS INTEGER) AS n, 'Part ' || l_partkey || ' & ' || l_returnflag AS title, CASE WHEN key % 2 = 0 OR key % 11 = 0 THEN strftime(l_shipdate, '%-d %b %Y') ELSE strftime(l_shipdate, '%-d %b %y') END AS airdate, "
    "strftime(l_shipdate, '%Y-%m-%d') AS iso, '/ep/' || l_partkey AS link FROM sh JOIN li ON l_orderkey = key), "
    "eps AS (SELECT url, s, n, min(k) AS first, arg_max(title, k) AS title, arg_max(airdate, k) AS airdate, arg_max(iso, k) AS iso, arg_max(link, k) AS link FROM rows GROUP BY url, s, n), "
    "numbered AS (SELECT eps.*, row_number() OVER (PARTITION BY url ORDER BY (s = 0), sf, first) AS overall FROM eps JOIN (SELECT url, s, min(k) AS sf FROM rows GROUP BY url, s) USING (url, s)), "
    "people AS (SELECT url, k, CASE WHEN l_suppkey % 4 = 0 THEN 'Extra ' || l_suppkey ELSE 'Person ' || l_suppkey || ' ' || l_returnflag END AS name, CASE WHEN l_suppkey % 4 <> 0 THEN '/p/' || l_suppkey || '/' || l_orderkey END AS href, "
    "CASE WHEN l_suppkey % 4 = 0 THEN ['cast'] ELSE ['Role ' || l_linestatus, 'Lead & Co'] END AS roles FROM sh JOIN li ON l_orderkey = key), "
    "shows AS (SELECT url, key, 'kw' || key % 10 || ', & ' || o_orderpriority AS keywords, 'Show ' || key || ' & Co' AS title, strftime(o_orderdate, '%-d %b %Y') AS date_start, strftime(o_orderdate, '%Y-%m-%d') AS date_start_iso, "
    "CASE WHEN key % 3 <> 0 THEN strftime(o_orderdate, '%b %Y') END AS date_end, CASE WHEN key % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-01') END AS date_end_iso, "
    "CASE WHEN key % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Ended' WHEN o_orderstatus = 'O' THEN 'Current Show' ELSE 'On Hiatus' END AS status, CASE WHEN key % 5 <> 0 THEN 'Net ' || key % 4 END AS network, "
    "CASE WHEN key % 2 = 0 THEN 'US' ELSE 'UK' END AS country, ['30-60', '45', '20-25', NULL][1 + CAST(key % 4 AS INTEGER)] AS runtime_minutes, (SELECT count(*) FROM rows r WHERE r.url = sh.url) AS episode_count, "
    "CASE WHEN key % 3 = 0 THEN 'Drama,Comedy,War' ELSE 'News' END AS genres, 'A ' || o_orderpriority || ' show.' AS description, (SELECT count(DISTINCT s) FROM rows r WHERE r.url = sh.url AND s <> 0) AS season_count FROM sh)"
)


@query(f"WITH {BASE} SELECT * EXCLUDE (key) FROM shows")
def show_table(spark, sf_dir):
    return html.extract(show_pages(spark, sf_dir), wanted=("shows",))["shows"]


@query(f"WITH {BASE} SELECT name AS actor_name, arg_min([href], (url, k))[1] AS actor_url FROM people GROUP BY name")
def show_actors(spark, sf_dir):
    return html.extract(show_pages(spark, sf_dir, F.col), wanted=("cast",))["actors"]


@query(f"WITH {BASE} SELECT url AS show_url, name AS actor_name, unnest(roles) AS role FROM people")
def show_credits(spark, sf_dir):
    return html.extract(show_pages(spark, sf_dir, F.col), wanted=("cast",))["credits"].drop("position")


@query(f"WITH {BASE} SELECT url AS show_url, s AS season_number, count(*) AS episode_count FROM eps WHERE s <> 0 GROUP BY url, s")
def show_seasons(spark, sf_dir):
    return html.extract(show_pages(spark, sf_dir), wanted=("episodes",))["seasons"]


@query(f"WITH {BASE} SELECT url AS show_url, s AS season_number, n AS episode_number_in_season, CAST(overall AS INTEGER) AS episode_number_overall, title AS episode_title, airdate, iso AS airdate_iso, link AS episode_url FROM numbered")
def show_episodes(spark, sf_dir):
    return html.extract(show_pages(spark, sf_dir), wanted=("episodes",))["episodes"]


@query("SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'error: no content' WHEN o_orderkey % 7 = 0 THEN 'no_data' ELSE 'success' END AS status, count(*) AS n FROM orders GROUP BY 1")
def extraction_outcomes(spark, sf_dir):
    return html.outcomes(html.status(show_pages(spark, sf_dir, F.col)))


@query(f"WITH {BASE} SELECT 'shows' AS \"table\", count(*) AS n, count(DISTINCT title) AS d FROM shows UNION ALL SELECT 'actors', count(DISTINCT name), count(DISTINCT name) FROM people UNION ALL SELECT 'credits', sum(len(roles)), count(DISTINCT name) FROM people UNION ALL SELECT 'seasons', count(*), count(DISTINCT url) FROM (SELECT DISTINCT url, s FROM rows WHERE s <> 0) UNION ALL SELECT 'episodes', count(*), count(DISTINCT title) FROM eps")
def five_tables_written(spark, sf_dir):
    """The five tables written as tab-separated text and read back."""
    folder = fresh(spark, "tables")
    tables.write_tables(show_pages(spark, sf_dir), folder)
    names = {"shows": "title", "actors": "actor_name", "credits": "actor_name", "seasons": "show_url", "episodes": "episode_title"}
    counts = [tables.read_tsv(spark, f"{folder}/{t}", tables.SCHEMAS[t]).agg(F.lit(t).alias("table"), F.count("*").alias("n"), F.countDistinct(c).alias("d")) for t, c in names.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3]).unionByName(counts[4])


DOCS = (
    "labels AS (SELECT url, string_agg(title || ' (' || iso || ')', chr(10) ORDER BY overall) AS episodes FROM numbered GROUP BY url), "
    "names AS (SELECT url, string_agg(DISTINCT name, ', ' ORDER BY name) AS cast_names, (SELECT string_agg(DISTINCT r, ', ' ORDER BY r) FROM (SELECT unnest(roles) AS r FROM people q WHERE q.url = p.url)) AS characters FROM people p GROUP BY url)"
)


@query(
    f"WITH {BASE}, {DOCS} SELECT url, title, title AS show_title, genres, description, coalesce(cast_names, '') AS \"cast\", coalesce(status, '') AS status, coalesce(network, '') AS network, country, coalesce(episodes, '') AS episodes, coalesce(characters, '') AS characters, keywords "
    "FROM shows LEFT JOIN labels USING (url) LEFT JOIN names USING (url)"
)
def show_documents(spark, sf_dir):
    return catalog.page_docs(html.together(show_pages(spark, sf_dir)))


def wiki_pages(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """page_id, title, raw_text: an encyclopedia page for every other order; some are redirects or films, some years differ.
    Orders are dealt to parts, or else pages are made where their file's few splits are read."""
    key, s = F.col("o_orderkey"), lambda c: c.cast("string")
    year = F.year("o_orderdate") + F.when(key % 10 == 0, 3).otherwise(0)
    box = F.concat(
        F.lit("{{short}}{{Infobox television\n| name = X\n| alt_name = \n| creator = [[A|Ann "), s(F.col("o_custkey") % 5), F.lit("]]<ref>r</ref>\n| first_aired = {{start date|"), s(year),
        F.lit("|1|2}}\n| starring = {{plainlist|\n* Lead "), s(key % 9), F.lit("\n* [[B|Other]]\n}}\n| company = C1\n}}\n<!-- no -->'''Show''' is a [[drama|series]] about the number "), s(key),
        F.lit(". It ran for long. It ended. It is over.\n\n== Plot ==\nMore {{x{{y}}}} text.\n[[Category: Shows "), F.col("o_orderpriority"), F.lit("|k]]\n[[Category:TV]] [[Category:TV]]"),
    )
    raw = F.when(key % 19 == 0, "#REDIRECT [[x]]").when(key % 23 == 0, F.replace(box, F.lit("television"), F.lit("film"))).otherwise(box)
    orders = table(spark, sf_dir, "orders").filter(key % 2 == 0).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if parts:
        orders = orders.repartition(parts, "o_orderkey")
    return orders.select(key.alias("page_id"), F.concat(F.lit("Show "), s(key), F.lit(" & Co (American TV series)")).alias("title"), raw.alias("raw_text"))


WIKI = (
    "wiki AS (SELECT o_orderkey AS page_id, 'Show ' || o_orderkey || ' & Co (American TV series)' AS title, 'show ' || o_orderkey || ' & co' AS norm_title, CAST(year(o_orderdate) + CASE WHEN o_orderkey % 10 = 0 THEN 3 ELSE 0 END AS INTEGER) AS page_start_year, "
    "'Ann ' || o_custkey % 5 AS creator, 'Lead ' || o_orderkey % 9 || ', Other' AS starring, 'C1' AS production_company, 'Show is a series about the number ' || o_orderkey || '. It ran for long. It ended.' AS description, 'Shows ' || o_orderpriority || ', TV' AS categories "
    "FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0)"
)
WIKI_COLUMNS = ["page_id", "title", "norm_title", "page_start_year", "creator", "starring", "production_company", "description", "categories"]


@query(f"WITH {WIKI} SELECT {', '.join(WIKI_COLUMNS)} FROM wiki")
def wiki_shows(spark, sf_dir):
    return tables.wiki_shows(wiki_pages(spark, sf_dir)).select(*WIKI_COLUMNS)


@query(f"WITH {WIKI} SELECT page_id, categories FROM wiki WHERE contains(categories, '1-URGENT') OR contains(categories, '5-LOW')")
def wiki_shows_by_keyword(spark, sf_dir):
    """Keywords come from a file with comments and blank lines."""
    path = fresh(spark, "keywords")
    spark.createDataFrame([("# kept",), ("1-urgent",), ("",), ("  5-LOW ",)], "value string").coalesce(1).write.text(path)
    return tables.wiki_shows(wiki_pages(spark, sf_dir), tables.read_keywords(spark, path)).select("page_id", "categories")


@query(f"WITH {WIKI} SELECT page_id, norm_title, page_start_year, creator FROM wiki")
def dump_scan(spark, sf_dir):
    """The pages written as XML chunks and read as a dump; each page's chunk is known."""
    folder = fresh(spark, "dump")
    pages = wiki_pages(spark, sf_dir).select(F.col("page_id").alias("id"), "title", F.struct(F.struct(F.col("raw_text").alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")).alias("revision"))
    pages.write.format("xml").options(rootTag="mediawiki", rowTag="page").save(folder)
    read = tables.read_dump(spark, f"{folder}/*.xml")
    return tables.wiki_shows(read).select("page_id", "norm_title", "page_start_year", "creator")


@query(f"WITH {WIKI} SELECT (SELECT count(*) FROM wiki) AS rows, (SELECT count(*) FROM wiki) AS listed, true AS agree, 0 AS again")
def chunk_manifest(spark, sf_dir):
    """Pages ingested in two runs, and a third that finds nothing new: what the manifest says of each chunk is what came of it."""
    base, pages = fresh(spark, "chunks"), wiki_pages(spark, sf_dir)
    late = F.col("raw_text").contains("URGENT")
    run = lambda: ingest_chunks(spark, f"{base}/in", "page_id long, title string, raw_text string", f"{base}/out", f"{base}/manifest", f"{base}/checkpoint", transform=lambda df: tables.wiki_shows(df, kept=["chunk"]).select("page_id", "chunk"))
    for part in (late, ~late):
        pages.filter(part).write.mode("append").parquet(f"{base}/in")
        run()
    before = read_manifest(spark, f"{base}/manifest").count()
    run()
    lines = read_manifest(spark, f"{base}/manifest")
    counts = spark.read.parquet(f"{base}/out").groupBy("chunk").agg(F.count("*").alias("n"))
    both = lines.join(counts, lines["chunk_file"] == counts["chunk"], "full")
    return both.agg(F.sum("n").alias("rows"), F.sum("rows").alias("listed"), F.bool_and(F.coalesce("n", F.lit(0)) == F.col("rows")).alias("agree"), (F.count("chunk_file") - before).cast("int").alias("again"))


@query(f"WITH {BASE} SELECT name AS actor_name, count(*) AS n FROM (SELECT DISTINCT name FROM people) GROUP BY name")
def actors_over_runs(spark, sf_dir):
    """Actors of pages that come in two runs: each once, whichever run it came with first."""
    base, pages = fresh(spark, "actors"), show_pages(spark, sf_dir, F.col)
    late = F.crc32("url") > F.lit(1 << 31)
    for part in (late, ~late):
        pages.filter(part).write.mode("append").parquet(f"{base}/in")
        ingest_new(spark, f"{base}/in", "url string, html string", f"{base}/out", f"{base}/checkpoint", ["actor_name"], transform=lambda df: html.cast(html.parse(df, ("cast",))).select("actor_name", "actor_url"))
    return spark.read.parquet(f"{base}/out").groupBy("actor_name").agg(F.count("*").alias("n"))


JOINED = "j AS (SELECT s.*, w.page_id AS wiki_page_id, w.title AS wiki_title, w.creator AS wiki_creator, w.starring AS wiki_starring, w.description AS wiki_description, w.categories AS wiki_categories, w.page_start_year AS wiki_year, w.norm_title AS wiki_norm FROM (SELECT *, lower(title) AS norm_title, year(CAST(date_start_iso AS DATE)) AS start_year FROM shows) s FULL OUTER JOIN wiki w ON s.norm_title = w.norm_title AND s.start_year = w.page_start_year)"


def joined_tables(spark: SparkSession, sf_dir: str, shows: DataFrame) -> DataFrame:
    """Dealt to as many parts as show pages, which the join is only where that is more than the session has for shuffles."""
    parts = parts_for(spark, table(spark, sf_dir, "lineitem").count())
    more = parts > max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return catalog.join_wiki(shows, tables.wiki_shows(wiki_pages(spark, sf_dir, parts)), parts if more else None)


@query(f"WITH {BASE}, {WIKI}, {JOINED} SELECT url, title, norm_title, CAST(start_year AS INTEGER) AS start_year, wiki_page_id, wiki_title, wiki_creator, wiki_starring, wiki_description, wiki_categories, wiki_year AS wiki_page_start_year FROM j")
def joined_shows_wiki(spark, sf_dir):
    columns = "url title norm_title start_year wiki_page_id wiki_title wiki_creator wiki_starring wiki_description wiki_categories wiki_page_start_year".split()
    shows = html.extract(show_pages(spark, sf_dir), wanted=("shows",))["shows"]
    return joined_tables(spark, sf_dir, shows).select(*columns)


@query(
    f"WITH {BASE}, {WIKI}, {JOINED}, titles AS (SELECT url, string_agg(title, ' ' || chr(10) ORDER BY overall) AS titles FROM numbered GROUP BY url), chunks AS (SELECT url, string_agg(name || ' ' || r, ' ' ORDER BY k, i) AS credit_text FROM (SELECT url, k, name, unnest(roles) AS r, unnest(range(len(roles))) AS i FROM people) GROUP BY url) "
    "SELECT url, coalesce(title, wiki_title) AS show_name, CASE WHEN genres IS NULL THEN '' WHEN genres = 'News' THEN 'news' ELSE 'drama|comedy|war' END AS genre_list, CAST(coalesce(wiki_year, start_year) AS INTEGER) AS start_year, wiki_description, coalesce(wiki_starring, credit_text, '') AS cast_all, titles AS episode_titles, "
    "CASE WHEN runtime_minutes = '45' THEN 45 END AS runtime_minutes, CAST(episode_count AS INTEGER) AS episode_count, CASE WHEN wiki_categories IS NULL THEN '' ELSE lower(replace(wiki_categories, ', ', '|')) END AS category_list, "
    "concat_ws(' ', coalesce(title, wiki_title), description, wiki_description, genres, titles, nullif(coalesce(wiki_starring, credit_text, ''), ''), keywords, wiki_creator, wiki_categories) AS content_all FROM j LEFT JOIN titles USING (url) LEFT JOIN chunks USING (url)"
)
def search_documents(spark, sf_dir):
    docs = catalog.index_fields(joined_tables(spark, sf_dir, catalog.with_texts(html.together(show_pages(spark, sf_dir)))))
    listed = lambda c: F.array_join(c, "|")
    return docs.select("url", "show_name", listed("genres_exact").alias("genre_list"), "start_year", "wiki_description", "cast_all", "episode_titles", "runtime_minutes", "episode_count", listed("category_exact").alias("category_list"), "content_all")


#: Planted faults: column -> value of a sound row, and of a faulty one by the remainder of the key.
FAULTS = {
    "shows": {"keywords": ("'k'", "5", "''"), "title": ("'t'", "7", "NULL"), "date_start": ("'1 Jan 2001'", "11", "''"), "date_start_iso": ("'2001-01-01'", "13", "''"), "date_end": ("'x'", "3", "''"), "date_end_iso": ("'x'", "4", "NULL"), "runtime_minutes": ("'45'", "17", "''"), "status": ("CASE o_orderstatus WHEN 'F' THEN 'Ended' WHEN 'O' THEN 'Canceled' ELSE 'Odd' END", "19", "''"), "network": ("'n'", "23", "NULL"), "country": ("'US'", "29", "''"), "episode_count": ("'12'", "31", "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '1x' END"), "genres": ("'g'", "37", "''"), "season_count": ("'3'", "41", "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '-1' END")},
    "seasons": {"season_number": ("'1'", "5", "'x'"), "episode_count": ("'2'", "7", "''")},
    "episodes": {"season_number": ("'1'", "5", "NULL"), "episode_number_in_season": ("'1'", "7", "'1.5'"), "episode_number_overall": ("'1'", "11", "''"), "episode_title": ("'t'", "13", "''"), "airdate": ("'d'", "17", "''"), "airdate_iso": ("'2001-01-01'", "19", "NULL"), "episode_url": ("'u'", "23", "''")},
    "credits": {"actor_name": ("'a'", "5", "''"), "role": ("'r'", "7", "NULL")},
}
SOURCES = {"shows": ("orders", "o_orderkey", "url"), "seasons": ("lineitem", "l_orderkey + l_linenumber", "show_url"), "episodes": ("lineitem", "l_orderkey + l_partkey", "show_url"), "credits": ("lineitem", "l_orderkey + l_suppkey", "show_url")}


def faulty(name: str, source: str) -> str:
    """SQL of a table with faults; children of some shows have unknown ones, and some shows have none."""
    _, key, url = SOURCES[name]
    own = "'s' || CAST(o_orderkey AS STRING)" if name == "shows" else f"'s' || CAST(CASE WHEN ({key}) % 43 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS STRING)"
    columns = [f"CASE WHEN ({key}) % {by} = 0 THEN {bad} ELSE {good} END AS {c}" for c, (good, by, bad) in FAULTS[name].items()]
    return f"SELECT {own} AS {url}, {', '.join(columns)} FROM {source}"


def rules_sql() -> str:
    blank = lambda c: f"coalesce({c}, '') = ''"
    bad = lambda c: f"NOT regexp_full_match(coalesce({c}, ''), '[0-9]+')"
    over, known = "lower(status) IN ('ended', 'canceled', 'cancelled/ended')", "lower(status) IN ('current show', 'ended', 'on hiatus', 'canceled', 'cancelled/ended')"
    rules = {
        "shows": {"missing keywords": blank("keywords"), "missing title": blank("title"), "missing or invalid start date": f"{blank('date_start')} OR {blank('date_start_iso')}", "missing or invalid end date": f"({blank('date_end')} OR {blank('date_end_iso')}) AND {over}", "missing runtime": blank("runtime_minutes"), "missing status": blank("status"), "unrecognised status": f"NOT ({blank('status')}) AND NOT {known}", "missing network": blank("network"), "missing country": blank("country"), "missing episode count": blank("episode_count"), "invalid episode count": bad("episode_count"), "missing genres": blank("genres"), "missing season count": blank("season_count"), "invalid season count": bad("season_count")},
        "seasons": {"invalid season number": bad("season_number"), "invalid episode count": bad("episode_count")},
        "episodes": {"invalid season number": bad("season_number"), "invalid number in season": bad("episode_number_in_season"), "invalid overall number": bad("episode_number_overall"), "missing title": blank("episode_title"), "missing or invalid airdate": f"{blank('airdate')} OR {blank('airdate_iso')}", "missing url": blank("episode_url")},
        "credits": {"missing actor": blank("actor_name"), "missing role": blank("role")},
    }
    url = lambda t: SOURCES[t][2]
    parts = [f"SELECT '{t}' AS \"table\", {url(t)} AS url, '{rule}' AS rule FROM f_{t} WHERE {where}" for t, own in rules.items() for rule, where in own.items()]
    parts += [f"SELECT '{t}', show_url, 'unknown show' FROM f_{t} WHERE show_url NOT IN (SELECT url FROM f_shows)" for t in rules if t != "shows"]
    parts += [f"SELECT 'shows', url, 'without {t}' FROM f_shows WHERE url NOT IN (SELECT show_url FROM f_{t})" for t in rules if t != "shows"]
    return "WITH " + ", ".join(f"f_{t} AS ({faulty(t, SOURCES[t][0])})" for t in SOURCES) + " " + " UNION ALL ".join(parts)


@query(rules_sql())
def validate_tables(spark, sf_dir):
    return quality.validate({t: spark.sql(faulty(t, "{source}"), source=table(spark, sf_dir, SOURCES[t][0])) for t in SOURCES})
