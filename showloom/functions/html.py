"""Fields of a show's page by regular expressions, as column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from showloom.functions.dates import date_to_iso
from showloom.functions.text import genres, let, roles, strip_tags

#: A character reference: by number, or by a name of up to 32 characters.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: The references that most texts have, the ampersand last, so that none is decoded twice; and an ampersand of any other.
COMMON = {"lt": "<", "gt": ">", "quot": '"', "amp": "&"}
OTHER = rf"&(?!(?:{'|'.join(COMMON)});|[\t\n\f <&;]|\z)"
LINKED = r"(?:<a[^>]*>)?([^<]+?)(?:</a>)?"
#: Where pages keep each field (dot matches newlines, case ignored); the wanted group is a number.
#: Where case is ignored from the second character on, the first is looked for more quickly.
KEYWORDS = r"""(?s)<(?i)meta\s+name="keywords"\s+content="([^"]+)"\s*/?>"""
TITLE = r"""(?s)<(?i)div\s+class="center\s+titleblock".*?>\s*<h2>\s*<a[^>]*>([^<]+)</a>\s*</h2>"""
DATES = rf"(?is)Start\s+date:\s*{LINKED}\s*<br\s*/?>\s*End\s+date:\s*([^<]+?)\s*<br"
STATUS = rf"(?is)Status:\s*{LINKED}\s*<br"
NETWORK = r"(?is)Network\(s\):\s*(?:<a[^>]*>([^<]*)</a>\s*)?\(\s*<a[^>]*>([^<]+)</a>\s*\)(?:\s*/\s*.*?)?<br\s*/?>"
RUNTIME = r"(?is)Run\s*time:\s*([^<]+?)\s*<br\s*/?>"
GENRES = r"(?i)(?:<a[^>]*>)?Genre\(s\)(?:</a>)?\s*:\s*([^<]+)\s*<br\s*/?>"
BLURB = r"""(?s)<(?i)div\s+id="blurb"[^>]*>\s*(.*?)\s*(?:<br\s*/?>)?\s*</div>"""
#: Where the cast and the episode list start and end.
CREDITS = r"""<(?i)div\s+id="credits"[^>]*>""", r"<(?i)/div>"
EPISODES = r"""<(?i)div\s+id="eplist"[^>]*>""", r"<(?i)/(?:table|pre)>\s*</div>"
#: A role needs white space before its "as", so that names that end in "as" stay whole.
CAST = r"""(?is)<li(?![^>]*class=['"]lihd['"]).*?>\s*(?:<a[^>]*href="([^"]+)"[^>]*>\s*)?(?:<strong>\s*)?([^<]+?)(?:\s*</strong>)?(?:\s*</a>)?(?:\s+as\s+([^<\[]+?))?(?:\s*\[[^\]]*\])?\s*</li>"""
ROW = (
    r"""(?ism)(?:<tr>\s*<td\s+class='epinfo\s+right'>\s*(\d+)\.\s*</td>\s*<td\s+class='epinfo\s+left\s+pad'>\s*(\d+\s*-\s*\d+)\s*(?:&nbsp;)?\s*</td>\s*"""
    r"""<td\s+class='epinfo\s+right\s+pad'>\s*([^<]+?)\s*</td>\s*<td\s+class='eptitle\s+left'>\s*(?:<a[^>]*href="([^"]+)"[^>]*>)?([^<]+)</a?>.*?</td>\s*</tr>"""
    r"""|^\s*(\d+)\.\s+(\d+\s*-\s*\d+)\s+(\d{1,2}\s+[A-Za-z]{3}\s+\d{2,4})\s+<a[^>]*href="([^"]+)"[^>]*>([^<]+)</a>)"""
)


def names() -> tuple[dict[str, dict[str, str]], list[str]]:
    """Named references by their first letter, and those that need no semicolon, the longest first."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in sorted(html5.items()):
        by_letter.setdefault(name[0], {})[name] = text
    return by_letter, sorted((n for n in html5 if n[-1] != ";"), key=lambda n: (-len(n), n))


def numbered_character(number: Column) -> Column:
    """The character of a numeric reference: as browsers have it for Windows' codes, none for what is no character."""
    windows = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    special = F.element_at(F.create_map(*[F.lit(x) for p in windows.items() for x in p]), number)
    no_character = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(special.isNotNull(), special).when(number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd").when(no_character, "").otherwise(plain)


def decoded_reference(reference: Column) -> Column:
    """What a reference (with its ampersand) stands for; an unknown name stays, but for a known one that it starts with."""
    by_letter, short = names()
    # One literal that the optimizer turns into a map; a map of literals would be thousands of expressions.
    table = F.from_json(F.lit(json.dumps(by_letter)), "map<string, map<string, string>>")
    name = F.substr(reference, F.lit(2))
    start = F.regexp_extract(name, f"^(?:{'|'.join(short)})", 0)
    part = lambda own: F.concat(F.element_at(own, start), F.substr(name, F.char_length(start) + 1))
    named = let(F.element_at(table, F.substring(name, 1, 1)), lambda own: F.coalesce(F.element_at(own, name), F.when(start != "", part(own))))
    digits = F.regexp_extract(reference, "^&#0*([0-9]*)", 1)
    hexes = F.regexp_extract(reference, "^&#[xX]0*([0-9a-fA-F]*)", 1)
    value = lambda d, base: F.when(F.char_length(d) > 7, F.lit(0x110000)).when(d == "", F.lit(0)).otherwise(F.conv(d, base, 10).cast("int"))
    number = F.when(F.rlike(reference, F.lit("^&#[xX]")), value(hexes, 16)).otherwise(value(digits, 10))
    return F.when(F.startswith(reference, F.lit("&#")), let(number, numbered_character)).otherwise(F.coalesce(named, reference))


def common(text: Column) -> Column:
    """text with its common references decoded."""
    for name, character in COMMON.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    return text


def unescape(c: Column) -> Column:
    """c with its character references decoded, in one pass."""

    def decoded(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
        pieces = F.split(text, REFERENCE)
        joined = F.zip_with(found, pieces, lambda r, p: F.concat(p, F.when(r.isNotNull(), decoded_reference(r)).otherwise("")))
        return F.array_join(joined, "")

    return F.when(F.contains(c, F.lit("&")), let(c, lambda t: F.when(F.rlike(t, F.lit(OTHER)), decoded(t)).otherwise(common(t)))).otherwise(c)


def tidy(c: Column) -> Column:
    """Trimmed, runs of two white space characters or more as one blank."""
    return F.regexp_replace(F.btrim(c, F.lit(" \t\r\n")), r"\s{2,}", " ")


def clean(c: Column) -> Column:
    """Decoded, then as tidy() does."""
    return tidy(unescape(c))


def cleaned(rows: DataFrame, keep: list[str], parts: dict[str, Column]) -> DataFrame:
    """The columns keep of rows, and the named parts, clean."""
    every = F.transform(F.array(*parts.values()), lambda x: tidy(unescape(x)))
    rows = rows.select(*keep, every.alias("_parts"))
    return rows.select(*keep, *[F.col("_parts")[i].alias(name) for i, name in enumerate(parts)])


def first(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null without a match or of an empty group."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def between(c: Column, start: str, end: str) -> Column:
    """What stands between the first fit of start and the next one of end, null without both. Cutting at two short patterns
    is quicker than one that tries its end at every character."""

    def cut(rest: Column) -> Column:
        return let(F.regexp_replace(rest, rf"{end}(?s:.*)", ""), lambda own: F.when(own != rest, own))

    return let(F.regexp_extract(c, rf"{start}(?s:(.*))", 1), cut)


def runtime(c: Column) -> Column:
    """"a-b" of a range in minutes, else the first number, as text."""
    text = F.trim(F.replace(c, F.lit("min"), F.lit("")))
    bounds = r"^(\d+)\s*[/-]\s*(\d+)$"
    return F.when(F.rlike(text, F.lit(bounds)), F.concat_ws("-", F.regexp_extract(text, bounds, 1), F.regexp_extract(text, bounds, 2))).otherwise(first(text, r"(\d+)"))


#: Columns of shows before their counts.
FIELDS = ["url", "keywords", "title", "date_start", "date_start_iso", "date_end", "date_end_iso", "status", "network", "country", "runtime_minutes"]
#: What pages are parsed for: the show's fields, the cast, the episode rows.
WANTED = ("shows", "cast", "episodes")
#: Pages of a partition on average, at most.
PAGES = 50_000


def parse(pages: DataFrame, wanted: tuple[str, ...] = WANTED, untitled: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """pages (url, html) with the show's fields, cast and episode rows, each an array of its clean parts; rows without a title
    are left out, or with untitled have nulls but for their URL and the columns to keep.

    One pass over the pages. The five tables are projections of it, so it is worth writing first where more than one of
    them is wanted, as write_tables() does. Only the parts that are wanted are looked for: clean parts are one expression,
    of which the optimizer can leave nothing out. For shows the episode rows are parsed too. A filter by the title is moved
    before what makes the page, which is then made twice: once for the filter. So where pages are made, not read, and rows
    without a title can be left out after a window or a file, untitled is quicker.
    """
    page = F.col("html")
    parts = {"title": first(page, TITLE)}
    if "shows" in wanted:
        parts |= {
            "keywords": first(page, KEYWORDS), "date_start": first(page, DATES, 1), "date_end": first(page, DATES, 2), "status": first(page, STATUS), "network": first(page, NETWORK, 1),
            "country": first(page, NETWORK, 2), "runtime": first(page, RUNTIME), "genre_list": first(page, GENRES), "blurb": first(page, BLURB),
        }
    if "cast" in wanted:
        parts["credit_block"] = F.nullif(F.btrim(between(page, *CREDITS), F.lit(" \t\n\x0b\f\r")), F.lit(""))
    # The filter is by an expression of its own: put on the clean parts it would be moved before them, with all of them.
    # Its page is named once, as the optimizer puts what makes the page in place of each name.
    titled = lambda p: let(F.regexp_extract(p, TITLE, 1), lambda t: clean(t) != "")
    rows = pages.select("url", *keep, let(page, lambda p: F.when(titled(p), p)).alias("html")) if untitled else pages.filter(F.coalesce(titled(page), F.lit(False)))
    kept = ["url", *keep]
    if "shows" in wanted or "episodes" in wanted:
        # The mark stands for the tag before, so that no line starts there.
        block = F.coalesce(F.concat(F.lit(">"), between(page, *EPISODES)), page)
        rows, kept = rows.withColumn("episode_rows", listed(block, ROW, *(EPISODE if "episodes" in wanted else EPISODE[:1]))), [*kept, "episode_rows"]
    rows = cleaned(rows, kept, parts)
    own = []
    if "shows" in wanted:
        rows = rows.withColumn("date_end", F.when(F.col("date_end") != "___ ____", F.col("date_end")))
        own = [
            "keywords", "title", "date_start", "date_end", "status", F.nullif("network", F.lit("")).alias("network"), "country", runtime(F.col("runtime")).alias("runtime_minutes"),
            F.nullif(genres(F.col("genre_list")), F.lit("")).alias("genres"), F.nullif(strip_tags(F.col("blurb")), F.lit("")).alias("description"), date_to_iso(F.col("date_start")).alias("date_start_iso"), date_to_iso(F.col("date_end")).alias("date_end_iso"),
        ]
    if "cast" in wanted:
        own.append(listed(F.col("credit_block"), CAST, *PERSON).alias("cast_rows"))
    return rows.select(*kept, *own)


def listed(block: Column, pattern: str, *numbers: str) -> Column:
    """array<array<string>>: for each place of a text that the pattern fits, a clean part for each number of a group (or
    several, of which one is found), null where it is empty.

    The text is gone through once: what the pattern skips is dropped, and the groups stay in one text, between marks. If
    all of that is tidy and has common references only, it is decoded at once; else each part is cleaned for itself.
    """
    mark, end = "\x01", "\x02"
    untidy = rf"{OTHER}|\s[\s{mark}{end}]|[{mark}{end}]\s|^\s"

    def rows(text: Column, form: Callable[[Column], Column]) -> Column:
        pieces = let(F.split(text, end), lambda p: F.slice(p, 1, F.size(p) - 1))  # what is after the last place is no row
        return F.transform(pieces, lambda r: F.transform(F.split(r, mark), lambda x: form(F.nullif(x, F.lit("")))))

    def once(text: Column) -> Column:
        fitted = F.rtrim(F.regexp_replace(text, rf"(?s)\G.*?(?:{pattern})", mark.join(numbers) + end), F.lit(" \t\r\n"))
        return let(fitted, lambda t: F.when(F.rlike(t, F.lit(untidy)), rows(t, clean)).otherwise(rows(common(t), lambda x: x)))

    def singly(text: Column) -> Column:
        """The same of a text that has a mark itself."""
        part = lambda row, n: F.coalesce(*[first(row, pattern, int(g)) for g in n.strip("$").split("$")])
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda row: F.transform(F.array(*[part(row, n) for n in numbers]), clean))

    return let(block, lambda t: F.when(F.contains(t, F.lit(mark)) | F.contains(t, F.lit(end)), singly(t)).otherwise(once(t)))


#: Groups of a row of the cast: name, URL, roles; and of an episode row: season and number, title, date, URL.
PERSON = "$2", "$1", "$3"
EPISODE = "$2$7", "$5$10", "$3$8", "$4$9"


def person(row: Column, at: Column) -> Column:
    """at, actor_name, actor_url, roles of a row of the cast."""
    name, link, role = [F.get(row, F.lit(i)) for i in range(3)]
    return F.struct(at.alias("at"), F.trim(name).alias("actor_name"), link.alias("actor_url"), roles(role).alias("roles"))


def episode_key(row: Column) -> list[Column]:
    """season_number, episode_number_in_season of an episode row."""
    pair = F.split(F.get(row, F.lit(0)), "-")
    return [F.get(pair, F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(("season_number", "episode_number_in_season"))]


def episode(row: Column, at: Column) -> Column:
    """at, season_number, episode_number_in_season, episode_title, airdate, airdate_iso, episode_url of an episode row."""
    title, day, link = [F.get(row, F.lit(i)) for i in range(1, 4)]
    return F.struct(at.alias("at"), *episode_key(row), title.alias("episode_title"), day.alias("airdate"), date_to_iso(day).alias("airdate_iso"), F.trim(link).alias("episode_url"))


def is_apart(parsed: DataFrame, name: str) -> bool:
    return dict(parsed.dtypes)[name].startswith("array<struct")


def apart(parsed: DataFrame) -> DataFrame:
    """parsed with its rows of the cast and of episodes taken apart, to be written for uses of several tables: then no table
    parses a row again."""
    return parsed.withColumns({name: F.transform(name, form) for name, form in (("cast_rows", person), ("episode_rows", episode)) if name in parsed.columns})


def cast(parsed: DataFrame) -> DataFrame:
    """url, at, actor_name, actor_url, roles."""
    people = F.col("cast_rows") if is_apart(parsed, "cast_rows") else F.transform("cast_rows", person)
    # Filtered in the array, as a filter behind would have each row parsed once more.
    return parsed.select("url", F.explode(F.filter(people, lambda x: x["actor_name"] != "")).alias("x")).select("url", "x.*")


def actors(cast: DataFrame) -> DataFrame:
    """actor_name (unique) and the URL at its first place, by the page's URL and then the place in the cast."""
    return cast.groupBy("actor_name").agg(F.min_by(F.struct("actor_url"), F.struct("url", "at")).alias("a")).select("actor_name", "a.actor_url")


def credits(cast: DataFrame) -> DataFrame:
    """show_url, actor_name, role and position, the place of the row among those of its show."""
    rows = cast.select(F.col("url").alias("show_url"), "at", "actor_name", F.posexplode("roles").alias("k", "role"))
    return rows.select("show_url", "actor_name", "role", (F.col("at").cast("long") * (1 << 20) + F.col("k")).alias("position"))


def episode_rows(parsed: DataFrame) -> DataFrame:
    """Every row of the episode lists: url, at, season_number, episode_number_in_season, title, airdate, iso, link."""
    rows = F.col("episode_rows") if is_apart(parsed, "episode_rows") else F.transform("episode_rows", episode)
    return parsed.select("url", F.explode(rows).alias("x")).select("url", "x.*")


def parts_for(parsed: DataFrame) -> int | None:
    """How many parts written pages are to be dealt to by URL, None where the session's number will do."""
    parts = math.ceil(parsed.count() / PAGES)
    return parts if parts > int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """rows dealt by URL to so many parts, where a number is given."""
    return rows.repartition(parts, "url") if parts else rows


def episodes(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Of rows of one season and number the last, at the first one's place; numbered over seasons, specials last."""
    # The first window is by show alone: rows are dealt by show once, or not at all if they are already, and what follows
    # is by show and more, so it shuffles nothing.
    peers = Window.partitionBy("url").orderBy("season_number").rangeBetween(Window.currentRow, Window.currentRow)
    known = dealt(rows.filter("url is not null and season_number is not null"), parts).withColumn("season_first", F.min("at").over(peers))
    e = F.struct("episode_title", "airdate", "airdate_iso", "episode_url")
    seasons = known.groupBy("url", "season_number", "episode_number_in_season").agg(F.min("at").alias("first"), F.min("season_first").alias("season_first"), F.max_by(e, "at").alias("e"))
    # A show's episodes are few; the window's partitions are shows.
    order = Window.partitionBy("url").orderBy(F.col("season_number") == 0, "season_first", "first")
    numbered = seasons.withColumn("episode_number_overall", F.row_number().over(order))
    return numbered.select(F.col("url").alias("show_url"), "season_number", "episode_number_in_season", "episode_number_overall", "e.*")


def seasons(parsed: DataFrame) -> DataFrame:
    """Distinct episodes by season; specials have no season."""
    # A page's rows are few: they are made distinct within it, so that fewer are shuffled.
    known = lambda x: F.struct(x["season_number"].alias("season_number"), x["episode_number_in_season"].alias("episode_number_in_season"))
    own = F.filter(F.array_distinct(F.transform("episode_rows", known if is_apart(parsed, "episode_rows") else lambda x: F.struct(*episode_key(x)))), lambda x: x["season_number"] != 0)
    rows = parsed.select("url", F.explode(own).alias("x")).select("url", "x.*")
    return rows.groupBy(F.col("url").alias("show_url"), "season_number").agg(F.countDistinct("episode_number_in_season").alias("episode_count"))


def shows(parsed: DataFrame, parts: int | None = None) -> DataFrame:
    """Shows with counts: all episode rows, and distinct seasons other than specials. Pages of one URL have counts over
    all of them."""
    season = (lambda x: x["season_number"]) if is_apart(parsed, "episode_rows") else lambda x: episode_key(x)[0]
    own = F.filter(F.array_distinct(F.transform("episode_rows", season)), lambda s: s != 0)
    # Counted within a page, then over its URL, so pages are parsed once and shuffled once.
    rows = parsed.select(*FIELDS, "genres", "description", F.size("episode_rows").cast("long").alias("n"), own.alias("own"))
    rows, same = dealt(rows, parts), Window.partitionBy("url")
    known = lambda c, name: F.when(F.col("url").isNotNull(), c).otherwise(0).cast("long").alias(name)
    every = F.size(F.array_distinct(F.flatten(F.collect_list("own").over(same))))
    return rows.select(*FIELDS, known(F.sum("n").over(same), "episode_count"), "genres", "description", known(every, "season_count"))


def in_order(rows: Column) -> Column:
    """The episodes of a show's rows (an array, taken apart) in their overall order, as episodes() makes them."""
    key = lambda x: F.struct(x["season_number"].alias("s"), x["episode_number_in_season"].alias("n"), x["at"].alias("at"), x.alias("x"))

    def made(known: Column) -> Column:
        """Of rows by season, number and place: those of one season and number are a run, of which the last is taken."""
        same = lambda i, c: F.get(known, i)[c].eqNullSafe(F.get(known, i - 1)[c])
        starts = F.filter(F.sequence(F.lit(0), F.size(known) - 1), lambda i: (i == 0) | ~(same(i, "s") & same(i, "n")))
        first = lambda s: F.array_min(F.transform(F.filter(known, lambda x: x["s"] == s), lambda x: x["at"]))
        firsts = let(F.array_distinct(F.transform(known, lambda x: x["s"])), lambda s: F.map_from_arrays(s, F.transform(s, first)))
        last = lambda b: F.get(known, F.coalesce(b, F.size(known)) - 1)
        run = lambda m: lambda a, b: let(last(b), lambda x: F.struct((x["s"] == 0).alias("special"), F.element_at(m, x["s"]).alias("season"), F.get(known, a)["at"].alias("first"), x["x"].alias("x")))
        runs = let(firsts, lambda m: let(starts, lambda i: F.zip_with(i, F.slice(i, 2, F.size(i)), run(m))))
        return F.transform(F.sort_array(runs), lambda x: x["x"])

    known = F.sort_array(F.transform(F.filter(rows, lambda x: x["season_number"].isNotNull()), key))
    return let(known, lambda k: F.when(F.size(k) > 0, made(k)).otherwise(F.filter(rows, lambda _: F.lit(False))))


def together(pages: DataFrame) -> DataFrame:
    """A row for each of pages (url, html) with a title: the fields and counts of shows(); cast_rows, its own people; and of
    all pages of its URL episodes (in their overall order) and people. leads: whether it is the first row of its URL.

    Pages that are dealt and sorted by URL are gone through once: nothing is written, shuffled or sorted. A show's rows are
    few.
    """
    parsed = apart(parse(pages.withColumn("_place", F.monotonically_increasing_id()), untitled=True, keep=("_place",)))
    people = lambda rows: F.filter(rows, lambda x: x["actor_name"] != "")
    same = Window.partitionBy("url")
    every = lambda c: F.flatten(F.collect_list(c).over(same))
    known = lambda c, name: F.when(F.col("url").isNotNull(), c).otherwise(0).cast("long").alias(name)
    rows = parsed.withColumns({"cast_rows": people("cast_rows")}).select("*", every("episode_rows").alias("rows"), every("cast_rows").alias("people"), F.min(F.when(F.col("title").isNotNull(), F.col("_place"))).over(same).alias("_first"))
    seasons = F.filter(F.array_distinct(F.transform("rows", lambda x: x["season_number"])), lambda s: s != 0)
    # After the window, as before it the filter would have every page made twice.
    return rows.filter("title is not null").select(*FIELDS, known(F.size("rows"), "episode_count"), "genres", "description", known(F.size(seasons), "season_count"), in_order(F.col("rows")).alias("episodes"), "cast_rows", "people", (F.col("_place") == F.col("_first")).alias("leads"))


def tables_together(rows: DataFrame) -> dict[str, DataFrame]:
    """The five tables of what together() makes, which is worth writing first. But for actors nothing is shuffled."""
    leading = rows.filter("leads").select(F.col("url").alias("show_url"), "episodes")
    numbers = lambda e: F.filter(F.array_distinct(F.transform(e, lambda x: x["season_number"])), lambda s: s != 0)
    counted = F.transform(numbers(F.col("episodes")), lambda s: F.struct(s.alias("season_number"), F.size(F.filter("episodes", lambda x: (x["season_number"] == s) & x["episode_number_in_season"].isNotNull())).cast("long").alias("episode_count")))
    people = rows.select("url", F.explode("cast_rows").alias("x")).select("url", "x.*")
    each = leading.filter("show_url is not null").select("show_url", F.posexplode("episodes").alias("k", "x"))
    return {
        "shows": rows.select(*FIELDS, "episode_count", "genres", "description", "season_count"),
        "actors": actors(people),
        "credits": credits(people),
        "seasons": leading.select("show_url", F.explode(counted).alias("x")).select("show_url", "x.*"),
        "episodes": each.select("show_url", "x.season_number", "x.episode_number_in_season", (F.col("k") + 1).alias("episode_number_overall"), "x.episode_title", "x.airdate", "x.airdate_iso", "x.episode_url"),
    }


def tables_of(parsed: DataFrame, parts: int | None = None) -> dict[str, DataFrame]:
    """The five tables of parsed pages, those that they were parsed for.

    Shows and episodes are made by URL. Pages that aren't dealt by it are dealt to parts, or else to as many as the session
    has for shuffles, which a large table outgrows."""
    out = {}
    if "title" in parsed.columns:
        out["shows"] = shows(parsed, parts)
    if "cast_rows" in parsed.columns:
        people = cast(parsed)
        out |= {"actors": actors(people), "credits": credits(people)}
    if "episode_rows" in parsed.columns:
        out |= {"seasons": seasons(parsed), "episodes": episodes(episode_rows(parsed), parts)}
    return out


def extract(pages: DataFrame, kept: bool = False, wanted: tuple[str, ...] = WANTED) -> dict[str, DataFrame]:
    """The tables of pages (url, html) that come of what is wanted; kept: parsed pages are written first, for uses of more
    than one table."""
    parsed = parse(pages, wanted)
    return tables_of(apart(parsed).checkpoint() if kept else parsed)


def outcomes(statuses: DataFrame) -> DataFrame:
    """status, n."""
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def status(pages: DataFrame) -> DataFrame:
    """url, status: success, no_data, or an error for a page that couldn't be read."""
    title = first(F.col("html"), TITLE)
    return pages.select("url", F.when(F.col("html").isNull(), "error: no content").when(title.isNull(), "no_data").otherwise("success").alias("status"))
