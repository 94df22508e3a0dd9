"""Stored pages, the crawl that fetches them, and robots rules."""

import random
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from showloom.functions import urls
from showloom.operators import crawl, robots
from showloom.sources import tables


@pytest.mark.parametrize("sent", [200_000, 3])
def test_pages_are_read_by_their_whole_path(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(tables, "SENT", sent)
    rows = [("data/a/index.html", "A\r\nline"), ("data/b/index.html", "B"), ("data/c d+e%20é/x.html", "C"), ("data/b", "a folder of another page's"), ("./data/z.html", "old", 1), ("data/z.html", "new", 2), ("data/none.html", None)]
    pages = spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else 0) for r in rows], "path string, html string, n int")
    tables.write_files(pages, f"file://{tmp_path}/store", "n")
    mapping = spark.createDataFrame([(f"u{i}", p) for i, p in enumerate(["data/a/index.html", "data/b/index.html", "./data/c d+e%20é/x.html", "data/b", "data/z.html", "data/none.html", "data/no/index.html", "data/a/index.html", None])], "url string, path string")
    got = {r["url"]: r["html"] for r in tables.read_pages(spark, mapping, f"{tmp_path}/store").collect()}
    assert got == {"u0": "A\r\nline", "u1": "B", "u2": "C", "u3": None, "u4": "new", "u5": None, "u6": None, "u7": "A\r\nline", "u8": None}
    with pytest.raises(Exception, match="outside"):
        tables.write_files(spark.createDataFrame([("../x", "y")], "path string, html string"), f"{tmp_path}/store")


def test_page_stored_again_is_the_last(spark, tmp_path):
    for html in ("z first", "a last"):
        tables.store_pages(spark.createDataFrame([("http://h/x", html)], "url string, html string"), f"{tmp_path}/s", f"{tmp_path}/m")
    assert [r["html"] for r in tables.stored_pages(spark, f"{tmp_path}/s", f"{tmp_path}/m").collect()] == ["a last"]


SITE = "http://h.example/"
LINKS = {"": "a b c http://other.example/x", "a": "b d mailto:x", "b": "missing /secret/x /secret/open", "d": "e a", "e": "f", "secret/open": "g"}


def server(log):
    """A stub that serves LINKS and writes down what it is asked for."""

    def get(url):
        with open(log, "a") as out:
            out.write(url + "\n")
        name = url.removeprefix(SITE)
        if name == "c":
            return 200, "image/png", "no page"
        if name == "missing":
            raise OSError("timed out")
        if name not in LINKS:
            return 404, "text/html", "<a href='h'>"
        return 200, "Text/HTML; charset=utf-8", "".join(f'<a href="{x}">' for x in LINKS[name].split())

    return get


def test_crawl_fetches_once_and_goes_on(spark, tmp_path):
    rules = robots.rule_table(spark.createDataFrame([("H.example", "User-agent: *\nDisallow: /secret/\nAllow: /secret/open\n")], "host string, text string"))
    seeds, log = spark.createDataFrame([(SITE,), (SITE,), (None,)], "url string"), tmp_path / "log"
    run = lambda depth: {r["url"].removeprefix(SITE): (r["level"], r["html"] is not None) for r in crawl.fetch_all(seeds, server(str(log)), f"file://{tmp_path}/crawl", SITE, rules, depth, delay=0.01, lanes=2).collect()}
    first = {"": (0, True), "a": (1, True), "b": (1, True), "c": (1, False)}
    assert run(1) == first
    whole = run(None)
    assert whole == first | {"d": (2, True), "missing": (2, False), "secret/open": (2, True), "e": (3, True), "g": (3, False), "f": (4, False)}
    asked = log.read_text().split()
    assert len(asked) == len(set(asked)) == len(whole)  # nothing twice, though it was started twice
    assert run(None) == whole and log.read_text().split() == asked
    mapped = tables.read_tsv(spark, f"{tmp_path}/crawl/map/*", tables.SCHEMAS["url_mapping"])
    assert {r["url"].removeprefix(SITE): r["path"] for r in mapped.collect()} == {k: urls_path(k) for k, (_, ok) in whole.items() if ok}
    # A level that wasn't written to its end is fetched again, others aren't.
    (tmp_path / "crawl/pages/level=3/_SUCCESS").unlink()
    assert run(None) == whole and sorted(log.read_text().split()[len(asked) :]) == [SITE + "e", SITE + "g"]


def urls_path(name):
    return f"data/{name or 'index.html'}"


def longest(text, url):
    """Whether the longest rule that fits, allowing ones first, lets a URL through, by regular expressions."""
    import re
    from urllib.parse import unquote

    best = (-1, True)
    target = unquote(url.split("example", 1)[1].split("#")[0]) or "/"
    for allow, path in urls.robots_lines(text):
        path = unquote(path)
        pattern = "".join(".*" if c == "*" else "$" if c == "$" and i == len(path) - 1 else re.escape(c) for i, c in enumerate(path))
        if re.match(pattern, target, re.S):
            best = max(best, (len(path), allow))
    return best[1]


def test_robots_of_many_hosts(spark):
    random.seed(4)
    parts = ["/", "/a", "/a/", "/a/b", "/c%20d", "/a*b", "/*.x$", "/é", "/a?q=", "*", "/x.(y", "/a/b$", "/p+q", "/$5"]
    files = {f"h{k}.example": "User-agent: *\n" + "\n".join(f"{random.choice(['Allow', 'Disallow'])}: {random.choice(parts)}" for _ in range(random.randrange(6))) for k in range(40)}
    files["h3.example"] = None
    tails = ["", "/", "/a", "/a/b/1", "/c d/1", "/c%20d", "/axxb", "/w/z.x", "/z.x/", "/%C3%A9t", "/a?q=1#f", "/x.(y)", "/a/b", "/p+q", "/p%2Bq", "/b%zz", "/$5"]
    rows = [(f"http://{h}{t}",) for h in [*files, "none.example"] for t in tails]
    pages, table = spark.createDataFrame(rows, "url string"), robots.rule_table(spark.createDataFrame([*files.items()], "host string, text string"))
    got = {r["url"]: r["allowed"] for r in robots.judged(pages, table).collect()}
    assert got == {u: longest(files.get(u.split("/")[2]), u) for (u,) in rows}
    assert 0.2 < sum(got.values()) / len(got) < 0.95
    first = {r["url"]: r["allowed"] for r in robots.judged(pages, table, first=True).collect()}
    for (u,) in rows:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse((files.get(u.split("/")[2]) or "").splitlines())
        # The standard parser takes a query apart in other ways than by its place, and keeps broken escapes as they are.
        if "?" not in u and "%zz" not in u:
            assert first[u] == parser.can_fetch("showloom", u), (u, files.get(u.split("/")[2]))
    odd = robots.judged(spark.createDataFrame([(None, 1)], "url string, _x int"), table)
    assert [tuple(r) for r in odd.collect()] == [(None, 1, True)]


def test_robots_groups():
    text = "Disallow: /x\nUser-agent: a\nUser-agent: b\nDisallow: /ab # why\nDisallow:\n\nUser-agent: *\nDisallow: /\nAllow: /p"
    assert urls.robots_lines(text, "B/1.0") == [(False, "/ab")]
    assert urls.robots_lines(text, "c") == [(False, "/"), (True, "/p")] and urls.robots_lines(None) == []
    assert urls.robots_rules(text, "c") == (["/"], ["/p"])


def test_polite_fetch_waits_for_a_host(spark, tmp_path):
    import time

    def get(url):
        with open(f"{tmp_path}/times", "a") as out:
            out.write(f"{url.split('/')[2]} {time.time()}\n")
        return 200, "text/html", "x"

    rows = spark.createDataFrame([(f"http://h{k % 2}/{k}",) for k in range(8)], "url string").withColumn("other", F.lit(1))
    assert crawl.fetch(rows, get, delay=0.2).filter("html = 'x'").count() == 8
    times = {}
    for line in open(f"{tmp_path}/times").read().splitlines():
        times.setdefault(line.split()[0], []).append(float(line.split()[1]))
    assert all(b - a >= 0.19 for t in times.values() for a, b in zip(sorted(t), sorted(t)[1:], strict=False))
