"""Operators on pairs and groups against brute force."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from showloom.llm import components, quotes, simhash


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_by_hand(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7)]
    random.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots_by_hand(edges, {n for e in edges for n in e})
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: r for n, r in want.items() if n not in alone}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints():
    for text in [None, "", " \n", "One", "a b c", "A b C d", "the cat sat on the mat " * 50, "é 漢 😀 x y z", "w " * 70_000]:
        if text is None or len(text) < 5000:
            assert simhash.fingerprint(text) == fingerprint_by_hand(text)
    assert simhash.fingerprint("w " * 70_000) == xxhash.xxh64_intdigest(b"w w w w", 42)


def near_sets(n, groups, size):
    """Fingerprints: n random ones, and groups around centres with up to 3 bits changed."""
    random.seed(n)
    fps = [random.getrandbits(64) for _ in range(n)]
    for _ in range(groups):
        centre = random.getrandbits(64)
        fps += [centre ^ sum({1 << random.randrange(64) for _ in range(random.randrange(4))}) for _ in range(size)]
    return np.unique(np.array(fps, np.uint64))


def links_by_hand(fps):
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4):
            yield i, i + 1 + int(j)


def gray(fps):
    for s in (1, 2, 4, 8, 16, 32):
        fps = fps ^ fps >> np.uint64(s)
    return fps


@pytest.mark.parametrize("sizes", [(0, 1, 3000), (1200, 4, 300), (500, 200, 3), (0, 1, 2), (2, 0, 0), (0, 1, 9), (1, 1, 70)])
def test_gray_index_finds_all_links(sizes):
    fps = near_sets(*sizes)
    fps = fps[np.argsort(gray(fps))]
    index = simhash.GrayIndex(fps, np.zeros(len(fps), np.int64))
    got = {(int(a), int(b)) for x, y in index.links(fps, index.buckets, np.full(len(fps), -1)) for a, b in zip(x, y, strict=True) if a < b}
    assert got == set(links_by_hand(fps))


def test_gray_index_prunes():
    fps = near_sets(4000, 0, 0)
    fps = fps[np.lexsort((gray(fps), fps >> np.uint64(58)))]  # 64 buckets
    index = simhash.GrayIndex(fps, (fps >> np.uint64(58)).astype(np.int64))
    assert {int(b) for _, y in index.links(fps, index.buckets, np.full(len(fps), -1)) for b in y} == set(range(len(fps)))  # each finds itself
    assert index.compared < 3 * len(fps)  # of 63 in a bucket
    behind = simhash.GrayIndex(fps, index.buckets)
    assert not [x for x, _ in behind.links(fps, index.buckets, np.arange(len(fps))) if len(x)] and behind.compared < len(fps)
    off = simhash.GrayIndex(fps, index.buckets)
    off.levels = [(pattern, np.zeros_like(shared), low, high) for pattern, shared, low, high in off.levels]
    assert not [x for x, _ in off.links(fps, index.buckets, np.arange(len(fps))) if len(x)]
    assert off.compared == sum(n * (n - 1) // 2 for n in np.bincount(index.buckets)) > 40 * behind.compared  # patterns do the work
    clustered = np.sort(near_sets(0, 400, 10))
    clustered = clustered[np.argsort(gray(clustered))]
    index = simhash.GrayIndex(clustered, np.zeros(len(clustered), np.int64))
    assert sum(len(x) for x, _ in index.links(clustered, index.buckets, np.full(len(clustered), -1))) > 5 * len(clustered)
    assert index.compared < 0.1 * len(clustered) ** 2


@pytest.mark.parametrize("n", [2, 3, 9, 300])
def test_search_is_by_the_gray_index_at_any_size(n, monkeypatch):
    made = []
    monkeypatch.setattr(simhash, "GrayIndex", lambda *x, make=simhash.GrayIndex: made.append(make(*x)) or made[-1])
    fps = np.sort(near_sets(0, 1, 500))[:n]
    fps, zero = fps[np.argsort(gray(fps))], np.zeros(len(fps), np.int64)
    a, b = simhash.search(fps, np.arange(len(fps)), zero, zero > 0, zero)
    assert roots_by_hand(zip(a.tolist(), b.tolist(), strict=True), range(len(fps))) == roots_by_hand(links_by_hand(fps), range(len(fps)))
    assert len(made) == 1 and made[0].tested and made[0].compared >= len(fps) - 1


@pytest.mark.parametrize("runs,cap", [(5, 1024), (5, 40), (6, 64), (8, 1024), (8, 20)])
def test_edges_connect_all_links(spark, runs, cap, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", cap)
    monkeypatch.setattr(simhash, "ROWS", 64)
    monkeypatch.setattr(simhash, "runs_for", lambda n: runs)
    fps = near_sets(600, 3, 150)
    rows = [(int(f), i) for i, f in enumerate(fps.view(np.int64))]
    edges = [tuple(r) for r in simhash.find_edges(spark.createDataFrame(rows, "fp long, rep long")).collect()]
    assert roots_by_hand(edges, range(len(fps))) == roots_by_hand(links_by_hand(fps), range(len(fps)))


def test_deduplicate(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(700).collect()]
    texts += [texts[3], texts[3] + " end", None, "", " ", texts[9][:-3], texts[12].upper()]
    docs = spark.createDataFrame([(10 * i if i != 5 else None, t, "c", "k") for i, t in enumerate(texts)] + [(0, texts[0], "c", "k")], "doc_id long, text string, component_id string, fp string")
    rows = [(r["doc_id"], fingerprint_by_hand(r["text"])) for r in docs.collect()]
    fps = np.unique(np.array([f for d, f in rows if d is not None], np.uint64))
    roots = roots_by_hand(links_by_hand(fps), range(len(fps)))
    at = {int(f): roots[i] for i, f in enumerate(fps)}
    least = {}
    for d, f in rows:
        if d is not None:
            least[at[f]] = min(d, least.get(at[f], d))
    want = collections.Counter((d, f"{f:016x}", None if d is None else least[at[f]]) for d, f in rows)
    assert collections.Counter(map(tuple, simhash.deduplicate(docs).collect())) == want
    kept = simhash.keep_one(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(d) for d in [None, *set(least.values())])
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_keep_one_of_ids_with_several_texts(spark):
    lone = {5 + k: f"a text of its own numbered {k} and " + " ".join(f"w{k}x{i}" for i in range(40)) for k in range(12)}
    shared = "the copy that a smaller id has too " * 9
    rows = [(3, shared)] + [r for i, t in lone.items() for r in ([(i, shared), (i, t)] if i % 2 else [(i, t), (i, shared)])]
    got = simhash.keep_one(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(3, shared), *lone.items()])


def test_quotes(spark):
    a0 = "First question about rivers.\n\nSecond thought on bridges."
    a1 = "Bob wrote:\n> First question about  RIVERS.\nThey flow."
    a2 = "> > First question about rivers.\n> They flow.\n\nIndeed they do.\n\n> unknown words\n\nBye."
    b0 = "Second thought on bridges.\nMore."
    b1 = ">> nothing like it\n> Indeed they do.\nLinked across."
    rows = [(1, 0, "user", a0), (1, 1, "user", a1), (1, 2, "user", a2), (2, 0, "user", b0), (2, 1, "user", b1), (2, 2, "user", "> Second thought on bridges.\nok"), (3, 0, "user", None), (None, 1, "user", "> They flow."), (4, None, "user", "x"), (5, 0, "user", ">>>"), (5, 0, "user", "> ok"), (6, 3, "user", "a > b is\n>no")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, place string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(df).collect() if r["conv_id"] != 5}
    link = lambda k: (got[k]["parent_conv_id"], got[k]["parent_turn"])
    assert got[1, 1]["text"] == "They flow." and link((1, 1)) == (1, 0) and got[1, 1]["n_linked"] == 1
    assert got[1, 2]["text"] == "Indeed they do.\nBye." and got[1, 0]["text"] == a0
    assert link((1, 2)) == (1, 1) and (got[1, 2]["n_quotes"], got[1, 2]["n_linked"], got[1, 2]["max_level"]) == (3, 2, 2)
    assert link((2, 1)) == (1, 2) and link((2, 2)) == (2, 0) and link((1, 0)) == (None, None)
    assert got[3, 0]["text"] == "" and got[3, 0]["place"] == 1 and got[None, 1]["place"] is None and got[4, None]["place"] is None
    assert got[6, 3]["text"] == "a > b is" and got[1, 2]["place"] == 3
    assert quotes.link(df).count() == len(rows) and quotes.link(df.limit(0)).count() == 0
    # Both rows answer (2, 2), which answers (2, 0).
    assert [(r["thread_conv_id"], r["depth"], r["place"]) for r in quotes.link(df).filter("conv_id = 5").collect()] == [(2, 2, 3)] * 2


def linked(spark, *texts):
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    return {r["turn"]: r for r in quotes.link(df).collect()}


def test_quotes_of_top_posted_threads(spark):
    quote = lambda t: "\n".join("> " + x if x else ">" for x in t.split("\n"))
    ann = "Where were you?"
    bob = f"At the coast.\n\nOn Monday, Ann wrote:\n{quote(ann)}"
    cid = f"For how long?\n\nOn Tuesday, Bob wrote:\n{quote(bob)}"
    dan = f"Two weeks.\n\nOn Friday, Cid wrote:\n{quote(cid)}"
    got = linked(spark, ann, bob, cid, dan, f"Only this.\n> On Monday, Ann wrote:\n> > {ann}")
    assert [got[t]["parent_turn"] for t in range(5)] == [None, 0, 1, 2, 0]
    assert [(got[t]["n_quotes"], got[t]["n_linked"], got[t]["max_level"]) for t in range(5)] == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3), (1, 1, 2)]
    assert [got[t]["text"] for t in range(5)] == [ann, "At the coast.", "For how long?", "Two weeks.", "Only this."]


def test_partial_quotes(spark):
    first = "Rivers rise in\nthe far hills.\n\nThey run to the sea,\npast the old mills,\nunder nine bridges.\n\nAnd so on."
    parts = ["Rivers rise in\n> the far hills.", "Rivers rise\n> in the far hills.", "they run to the sea,\n> past the old mills,", "past the old mills,\n> under nine bridges.\n>\n> And so on.", "Rivers rise in\n> [...]\n> under nine bridges."]
    none = ["past the old mills,\n> They run to the sea,", "Rivers rise in\n> the far mountains.", "And so on.\n> And so on."]
    later = "They run to the sea,\nfar away,\npast the old mills,"
    got = linked(spark, first, *[f"> {p}\nYes." for p in parts], *[f"> {p}\nNo." for p in none], later, "> far away,\n> past the old mills,\nOh.")
    assert [got[t]["parent_turn"] for t in range(1, 6)] == [0] * 5
    assert [got[t]["n_linked"] for t in range(6, 9)] == [0] * 3
    assert got[10]["parent_turn"] == 9


def squeeze(text):
    return re.sub("[\\s ]+", " ", text.lower()).strip(" ")


def parse_by_hand(text):
    """(level, text) of each passage, without attributions."""
    runs = []
    for line in (text or "").split("\n"):
        m = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
        n, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if runs and runs[-1][0] == n:
            runs[-1][1].append(rest)
        else:
            runs.append((n, [rest]))
    out = []
    for i, (n, lines) in enumerate(runs):
        whole = "\n".join(lines)
        if i + 1 < len(runs) and runs[i + 1][0] > n:
            bare = re.sub(r"(?i)(^|\n)[^\n]*(wrote|writes|schrieb|écrit|escribió)\s*:\s*$", "", whole)
            if n and whole.strip(" \t\r\n") and not bare.strip(" \t\r\n"):
                continue
            whole = bare
        out.append((n, whole))
    return out


def lines_by_hand(text):
    return [x for x in map(squeeze, text.split("\n")) if x and not re.fullmatch(r"[\[(<]*(\.{2,}|…|snip(ped)?)[\])>]*", x)]


def link_by_hand(rows):
    """All columns but role of quotes.link, for rows (conv_id, turn, text)."""
    parsed, units, lines = [], [], []
    for _, _, text in rows:
        found = parse_by_hand(text)
        own = [t for t in (p.strip(" \t\r\n") for n, p in found if n == 0) if t]
        parsed.append((found, own))
        every = {"\n".join(own), *own} | {x for p in own for x in re.split(r"\n[ \t\r]*\n\s*", p) + p.split("\n")}
        units.append({squeeze(x) for x in every})
        lines.append(lines_by_hand("\n".join(own)))

    def holds(k, quote, asked):
        rest = iter(lines[k])
        return quote in units[k] or bool(asked) and all(x in rest for x in asked)

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None or rows[k][1] is None, rows[k][0] or 0, rows[k][1] or 0))
    known = [k for k in order if None not in rows[k][:2]]
    where, counted, best = {}, collections.defaultdict(set), {}
    for k in known:
        conv, turn = key = rows[k][:2]
        for at, (n, text) in enumerate(parsed[k][0]):
            quote = squeeze(text)
            if not n or not quote:
                continue
            if quote not in where:
                asked = lines_by_hand(text)
                where[quote] = {}
            asked = tuple(lines_by_hand(text))
            if asked not in where[quote]:
                where[quote][asked] = [rows[j][:2] for j in known if holds(j, quote, asked)]
            found = where[quote][asked]
            target = next((m for m in found if m[0] == conv), None)
            if target is None or target[1] >= turn:
                target = found[0] if found and found[0][0] < conv else None
            if target:
                counted[key].add((at, quote, asked))
                best[key] = min(best.get(key, (n, at, target)), (n, at, target))

    def top(key):
        depth = 0
        while key in best:
            key, depth = best[key][2], depth + 1
        return key, depth

    threads = {rows[k][:2]: top(rows[k][:2]) for k in known}
    sorted_by = lambda key: (threads[key][0][1], threads[key][1], *key)
    by_conv = collections.defaultdict(list)
    for k in known:
        by_conv[threads[rows[k][:2]][0][0]].append(sorted_by(rows[k][:2]))
    out = []
    for k, (conv, turn, _) in enumerate(rows):
        found, own = parsed[k]
        levels, key = [n for n, _ in found], (conv, turn)
        base = (conv, turn, found[0][1] if max(levels) == 0 else "\n".join(own), sum(n > 0 for n in levels), len(counted[key]), max(levels))
        if None in key:
            out.append((*base, *[None] * 6))
        else:
            (a, b), depth = threads[key]
            out.append((*base, *(best[key][2] if key in best else (None, None)), a, b, depth, 1 + sum(x < sorted_by(key) for x in by_conv[a])))
    return out


def same_as_by_hand(spark, rows):
    df = spark.createDataFrame([(c, t, "user", x, "k", "k") for c, t, x in rows], "conv_id long, turn long, role string, text string, place string, passages string")
    got = quotes.link(df.repartition(3)).drop("role").collect()
    want = link_by_hand(rows)
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    return want


def test_quotes_of_mail_equal_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    plain = {(r["conv_id"], r["turn"]): r["text"] for r in table.collect()}
    rows = [(r["conv_id"], r["turn"], r["text"]) for r in quotes.as_mail(table).collect()]
    assert len(rows) == len(plain) and sum(">" in t for _, _, t in rows) > 0.4 * len(rows)
    want = same_as_by_hand(spark, rows)
    assert sum(r[6] is not None for r in want) > 0.4 * len(rows) and max(r[10] for r in want) > 3
    for r in want:  # what was added is taken off again
        assert r[2].strip() == plain[r[0], r[1]].strip()
    at = {r[:2]: r for r in want}
    for r in want:  # parents lead back, and replies come after what they answer
        if r[6] is not None:
            up = at[r[6], r[7]]
            assert up[:2] < r[:2] and up[8:10] == r[8:10] and up[10] + 1 == r[10] and up[11] < r[11]


def test_quotes_of_odd_messages_equal_brute_force(spark):
    random.seed(11)
    words = ["so it is", "no.", "Yes, yes", "a > b", "", " ", "\r", "On Monday, Ann wrote:", "...", "one line\nand another", "one line", "and another\n\nlast", "x" * 300 + " wrote:"]
    rows = []
    for c in range(12):
        for t in range(7):
            parts = [random.choice(words) for _ in range(random.randrange(1, 5))]
            parts += ["\n".join(random.choice(["> ", ">", "> > ", ">>>"]) + x for x in random.choice(words).split("\n")) for _ in range(random.randrange(4))]
            random.shuffle(parts)
            rows.append((c, t, "\n".join(parts)))
    deep = "\n".join(">" * k + f" level {k}" for k in range(300))
    rows += [(1, 2, "twice"), (1, 2, None), (3, 1, rows[22][2]), (None, 4, "> no."), (5, None, "> no."), (None, None, None), (20, 0, "aa\rbb\x01\x02"), (20, 1, "> aa bb"), (20, 2, deep), (20, 3, "line\n" * 5000), (20, 4, "> line\n" * 4000)]
    same_as_by_hand(spark, rows)


def test_quotes_never_point_in_circles(spark):
    got = linked(spark, "> second\nfirst", "> first\nsecond")
    assert (got[0]["parent_turn"], got[1]["parent_turn"]) == (None, 0)
    df = spark.createDataFrame([(4, 0, "user", "> fifth\nfourth"), (5, 0, "user", "> fourth\nfifth")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in quotes.link(df).collect()}
    assert (got[4]["parent_conv_id"], got[5]["parent_conv_id"]) == (None, 4) and (got[5]["thread_conv_id"], got[5]["place"]) == (4, 2)


def test_long_threads(spark):
    n = 70
    got = linked(spark, *[f"> message {t - 1}\nmessage {t}" for t in range(n)])
    assert [(got[t]["depth"], got[t]["thread_turn"], got[t]["place"]) for t in range(n)] == [(t, 0, t + 1) for t in range(n)]


def test_quotes_with_a_text_that_all_share(spark):
    n = 3000
    df = spark.createDataFrame([(c, t, "user", "Hello there everyone." if t == 0 else f"> Hello there everyone.\nreply {c}") for c in range(n) for t in (0, 1)], "conv_id long, turn long, role string, text string")
    got = quotes.link(df).filter("turn = 1")
    assert got.filter(F.col("parent_conv_id") == F.col("conv_id")).filter("parent_turn = 0").count() == n
