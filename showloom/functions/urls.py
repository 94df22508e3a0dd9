"""URLs of a crawl: links, resolution against the site's root, storage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = r"^(mailto|javascript|tel|data):"


def links(html: Column) -> Column:
    """array<string>: values of href attributes in order, quoted either way, within a line."""
    return F.regexp_extract_all(html, F.lit("""(?i)href=["'](.*?)["']"""), F.lit(1))


def is_skipped(link: Column) -> Column:
    return F.rlike(link, F.lit(SKIPPED))


def resolve(link: Column, root: str) -> Column:
    """A link against the site's root (a URL that ends in "/"); dot segments stay, but for resolve_exactly()."""
    scheme, host = root.split("://", 1)[0], "/".join(root.split("/", 3)[:3])
    return (
        F.when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit(f"{scheme}:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(F.lit(host), link))
        .when(link == "", F.lit(root))
        .otherwise(F.concat(F.lit(root), link))
    )


def without_dots(path: Column) -> Column:
    """A path from "/" on without its "." and ".." segments."""
    segments = F.slice(F.split(path, "/"), 2, 1 << 30)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    folder = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(F.rlike(path, F.lit(r"/\.\.?(/|$)")), F.when(F.endswith(joined, F.lit("/")), joined).otherwise(F.concat(joined, folder))).otherwise(path)


def resolve_exactly(link: Column, root: str) -> Column:
    """resolve(), without dot segments in the paths of links that have no host of their own, nor empty ones in relative
    paths."""
    whole = resolve(link, root)
    host, end = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", r"[?#].*$"
    own = F.rlike(link, F.lit("^([A-Za-z][A-Za-z0-9+.-]*:|//)"))
    path = F.when(F.startswith(link, F.lit("/")), path_of(whole)).otherwise(F.regexp_replace(path_of(whole), "/{2,}", "/"))
    plain = F.concat(F.regexp_extract(whole, host, 0), without_dots(path), F.regexp_extract(whole, r"(?s)" + end, 0))
    return F.when(own | ~F.rlike(link, F.lit(r"\.|//")), whole).otherwise(plain)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def store_path(url: Column, folder: str = "data") -> Column:
    """Where a page is stored: index.html for folders; a digest of the query, if any, before the extension."""
    path, query = path_of(url), query_of(url)
    path = F.when((path == "") | F.endswith(path, F.lit("/")), F.concat(path, F.lit("index.html"))).otherwise(path)
    extension = F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)
    root = F.substring(path, F.lit(1), F.char_length(path) - F.char_length(extension))
    named = F.concat(root, F.lit("__q_"), F.substring(F.sha1(query), 1, 10), F.coalesce(F.nullif(extension, F.lit("")), F.lit(".html")))
    return F.concat(F.lit(f"{folder}/"), F.regexp_replace(F.when(query != "", named).otherwise(path), "^/+", ""))


def allowed(url: Column, disallowed: list[str], permitted: list[str] = ()) -> Column:
    """Whether robots rules (path prefixes) let a URL be fetched; the longest prefix decides, allow before disallow."""
    target = F.concat(path_of(url), F.when(query_of(url) != "", F.concat(F.lit("?"), query_of(url))).otherwise(""))
    length = lambda prefixes: F.greatest(F.lit(-1), F.lit(-1), *[F.when(F.startswith(target, F.lit(p)), len(p)).otherwise(-1) for p in prefixes if p])
    return length(permitted) >= length(disallowed)


def robots_lines(text: str | None, agent: str = "*") -> list[tuple[bool, str]]:
    """(allow, path) of a robots.txt's rules for an agent, in order; without a group that names it, those for all. An
    empty path to disallow says nothing, so it is left out, as is what comes before any agent."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    agents, in_rules = [], False
    for line in (text or "").splitlines():
        key, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
        if key.lower() == "user-agent":
            agents, in_rules = ([] if in_rules else agents) + [value.lower()], False
            groups.setdefault(value.lower(), [])
        elif key.lower() in ("allow", "disallow"):
            in_rules = True
            for a in agents:
                groups[a].append((key.lower() == "allow", value))
    own = next((g for a, g in groups.items() if a and a != "*" and a in agent.lower()), groups.get("*", []))
    return [(allow, path) for allow, path in own if path]


def robots_rules(text: str | None, agent: str = "*") -> tuple[list[str], list[str]]:
    """Disallowed and allowed prefixes for an agent in a robots.txt; of no text, none."""
    rules = robots_lines(text, agent)
    return [p for allow, p in rules if not allow], [p for allow, p in rules if allow]
