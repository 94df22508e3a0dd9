"""Queries over stored indexes, vectors and files: batches, hits with their documents, repeated ids, robots rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from showloom.functions import urls
from showloom.operators import catalog, search
from showloom.operators.index import MODES, postings
from showloom.operators.numbering import numbered
from showloom.operators.vectors import Vectors
from showloom.plans.catalogue import COSINE, IDF, NORMS, PLACED, POSTINGS, STOPS, VECTOR, WORDS, built, fields, index, vectors
from showloom.plans.shared import fresh, query, r6, table
from showloom.sources import tables

TOP = COSINE.format(q=WORDS).replace(" SELECT doc_id, round(s, 6) AS score FROM scored ORDER BY", ", top AS (SELECT doc_id, s FROM scored ORDER BY") + ")"


@query(f"WITH {POSTINGS}, {NORMS.format(IDF['smooth'])}, {TOP} SELECT doc_id, round(s, 6) AS score, lang, source, left(text, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS snippet FROM top JOIN documents USING (doc_id)")
def search_hits(spark, sf_dir):
    """The best documents with stored columns and a cut description."""
    found = search.cosine(index(spark, sf_dir, ("smooth",)), WORDS)
    return search.hits(found, table(spark, sf_dir, "documents"), "lang", "source", description="text").withColumn("score", r6("score"))


@query(
    "WITH " + PLACED + "q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[-–—_:;/.,!?]+', ' ', 'g'), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY ALL), "
    "s AS (SELECT query_id, doc_id, sum(times * s) AS s FROM word JOIN q USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS r FROM s) SELECT query_id, doc_id, CAST(r AS INTEGER) AS rank, round(s, 6) AS score FROM r WHERE r <= 5"
)
def search_bm25_many(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_many(fields(spark, sf_dir, batches=True), queries).withColumn("score", r6("score"))


RAW = (
    f"raw AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]{{2,}}'))) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM raw WHERE term NOT IN ({STOPS}) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), "
    "w AS (SELECT term, count(*) AS df, ln((any_value(n) + 1.0) / (count(*) + 1.0)) AS idf FROM post, n GROUP BY term), vec AS (SELECT doc_id, term, tf * idf AS v FROM post JOIN w USING (term)), norms AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM vec GROUP BY doc_id)"
)
LISTED = ", ".join(f"'{w}'" for w in VECTOR.split())


@query(f"WITH {RAW} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, round(idf, 6) AS idf FROM w")
def vector_vocabulary(spark, sf_dir):
    store = vectors(spark, sf_dir)
    return store.vocab.join(store.idf, "term_id").select("term", "term_id", r6("idf").alias("idf"))


@query(f"WITH {RAW} SELECT doc_id, coalesce(count(term), 0) AS n, round(coalesce(sum(v), 0), 4) AS weight FROM documents LEFT JOIN vec USING (doc_id) GROUP BY doc_id")
def vector_rows(spark, sf_dir):
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return vectors(spark, sf_dir).rows.select("doc_id", F.size("ids").cast("long").alias("n"), F.round(total, 4).alias("weight"))


@query(
    f"WITH {RAW}, q AS (SELECT term, idf AS wq FROM w WHERE term IN ({LISTED})), dots AS (SELECT doc_id, sum(v * wq) AS dot FROM vec JOIN q USING (term) GROUP BY doc_id), "
    "s AS (SELECT doc_id, coalesce(dot, 0) / ((CASE WHEN norm = 0 THEN 1e-12 ELSE norm END) * (SELECT sqrt(sum(wq * wq)) FROM q)) AS s FROM norms LEFT JOIN dots USING (doc_id)), top AS (SELECT * FROM s ORDER BY round(s, 12) DESC, doc_id LIMIT 10) "
    "SELECT doc_id, lang AS url, CASE WHEN doc_id % 2 = 0 THEN 'doc ' || doc_id ELSE source END AS title, round(s, 6) AS score FROM top JOIN documents USING (doc_id)"
)
def vector_hits(spark, sf_dir):
    """Hits of the vector store: what the documents table lacks comes with the vector."""
    return vectors(spark, sf_dir).search(VECTOR).withColumn("score", r6("score"))


@query(
    f"WITH {RAW}, qt AS (SELECT query_id, term, count(*) AS c FROM (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]{{2,}}'))) AS term FROM benchmark) WHERE term NOT IN ({STOPS}) GROUP BY ALL), q AS (SELECT query_id, term, c * idf AS wq FROM qt JOIN w USING (term) WHERE idf <> 0), "
    "qn AS (SELECT query_id, sqrt(sum(wq * wq)) AS qn FROM q GROUP BY query_id), s AS (SELECT query_id, doc_id, sum(v * wq) / (any_value(norm) * any_value(qn)) AS s FROM vec JOIN q USING (term) JOIN norms USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS r FROM s) SELECT query_id, doc_id, CAST(r AS INTEGER) AS rank, round(s, 6) AS score FROM r WHERE r <= 3"
)
def vector_search_many(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return vectors(spark, sf_dir, batches=True).search_many(queries, 3).withColumn("score", r6("score"))


@query("SELECT 'idf, docs' AS missing, count(*) AS vectors FROM documents")
def vector_parts_missing(spark, sf_dir):
    """A store without two of its parts isn't opened, and the error names them."""
    folder = fresh(spark, "vectors")
    store = vectors(spark, sf_dir)
    store.vocab.limit(1).write.parquet(f"{folder}/vocab")
    store.rows.write.parquet(f"{folder}/rows")
    try:
        Vectors.load(spark, folder)
        found = ""
    except FileNotFoundError as e:
        found = str(e).split(" has no ", 1)[1]
    return spark.read.parquet(f"{folder}/rows").agg(F.lit(found).alias("missing"), F.count("*").alias("vectors"))


@query("WITH t AS (SELECT doc_id FROM documents WHERE len(regexp_extract_all(lower(text || ' ' || lang || ' ' || source), '[a-z0-9]+')) > 0) SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS dense_id FROM t")
def dense_document_ids(spark, sf_dir):
    """Numbers without gaps for the documents that have tokens."""
    return numbered(built(spark, sf_dir).ids(), "dense_id", "doc_id")


BY_TYPE = {"en": {"text": 0.5, "source": 3.0}, "de": {"text": 2.0, "source": 0.0}}


@query(
    "WITH f AS (SELECT doc_id, lang, 'text' AS field, text AS t FROM documents UNION ALL SELECT doc_id, lang, 'source', source FROM documents), w AS (SELECT *, CASE WHEN lang = 'en' THEN CASE field WHEN 'text' THEN 0.5 ELSE 3.0 END WHEN lang = 'de' THEN CASE field WHEN 'text' THEN 2.0 ELSE 0.0 END ELSE 1.0 END AS w FROM f), "
    "r AS (SELECT doc_id, field, w, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM w WHERE w > 0), c AS (SELECT doc_id, term, greatest(1, CAST(round_even(count(*) * CAST(any_value(w) AS DOUBLE), 0) AS BIGINT)) AS tf FROM r GROUP BY doc_id, term, field) SELECT doc_id, term, CAST(sum(tf) AS BIGINT) AS tf FROM c GROUP BY doc_id, term"
)
def term_freq_by_type(spark, sf_dir):
    """Weights by a document's type and field; a type or field without one has 1, and weight 0 leaves a field out."""
    return postings(table(spark, sf_dir, "documents"), BY_TYPE, fields=["text", "source"], by="lang")


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) || ':' || lang AS url, CASE WHEN doc_id % 3 = 0 THEN 'again ' || source ELSE source END AS title FROM documents")
def documents_last_wins(spark, sf_dir):
    """A table with repeated ids, ids that aren't numbers, and line breaks in fields: the last row of an id stays."""
    path = fresh(spark, "documents")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat("doc_id", F.lit(":"), "lang").alias("url"), F.col("source").alias("title"))
    again = docs.filter(F.col("doc_id").cast("long") % 3 == 0).withColumn("title", F.concat(F.lit("again "), "title"))
    first = docs.withColumn("title", F.when(F.col("doc_id").cast("long") % 3 == 0, F.concat(F.lit("zzz\n"), "title")).otherwise(F.col("title")))
    bad = docs.limit(1).withColumn("doc_id", F.lit("no number"))
    for i, rows in enumerate((bad, first, again)):  # a folder each, whose files come one after another by name
        tables.write_tsv(rows, f"{path}/{i}")
    return tables.read_documents(spark, f"{path}/*")


#: Pages and where they are stored, in SQL.
STORED = (
    "WITH p AS (SELECT page_id, url, html, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p0, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages), r AS (SELECT *, CASE WHEN p0 = '' OR ends_with(p0, '/') THEN p0 || 'index.html' ELSE p0 END AS p FROM p), e AS (SELECT *, regexp_extract(p, '[^/.][^/]*?(\\.[^./]*)$', 1) AS e FROM r), "
    "s AS (SELECT page_id, url, html, 'data/' || regexp_replace(CASE WHEN q <> '' THEN left(p, length(p) - length(e)) || '__q_' || left(sha1(q), 10) || CASE WHEN e = '' THEN '.html' ELSE e END ELSE p END, '^/+', '') AS path FROM e)"
)


@query(
    STORED
    + ", c AS (SELECT path, html FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY page_id % 2 DESC, html DESC) = 1) "
    "SELECT url, path, length(any_value(c.html)) AS n_chars FROM s JOIN c USING (path) GROUP BY url, path"
)
def page_store(spark, sf_dir):
    """Pages added to the store and the URL map in two runs, then read by the map."""
    pages, base = table(spark, sf_dir, "pages"), fresh(spark, "store")
    for part in (pages.filter("page_id % 2 = 0"), pages.filter("page_id % 2 = 1")):
        tables.store_pages(part, f"{base}/pages", f"{base}/map")
    return tables.stored_pages(spark, f"{base}/pages", f"{base}/map").select("url", "path", F.char_length("html").cast("long").alias("n_chars"))


@query(STORED + ", c AS (SELECT path, html FROM s WHERE page_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY page_id DESC) = 1), d AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE starts_with(o.path, c.path || '/'))) SELECT page_id, url, path, length(d.html) AS n_chars, md5(d.html) AS digest FROM s LEFT JOIN d USING (path)")
def mapped_pages(spark, sf_dir):
    """Two thirds of the pages stored as files of their own, then every page of the URL map with its file, if there is one."""
    base, pages = fresh(spark, "files"), table(spark, sf_dir, "pages").withColumn("path", urls.store_path(F.col("url")))
    tables.write_files(pages.filter("page_id % 3 <> 0"), base, "page_id")
    tables.write_tsv(pages.select("url", "path"), f"{base}-map")
    mapped = tables.read_tsv(spark, f"{base}-map", tables.SCHEMAS["url_mapping"]).distinct()  # pages may share a URL
    read = tables.read_pages(spark, mapped, base).select("url", "path", F.char_length("html").cast("long").alias("n_chars"), F.md5("html").alias("digest"))
    return pages.select("page_id", "url").join(read, "url").select("page_id", "url", "path", "n_chars", "digest")


@query("SELECT count(*) AS written, count(*) AS read, sum(least(length(text), 4000))::BIGINT AS chars, (max(length(text)) > 4000) AS was_cut FROM documents")
def table_written(spark, sf_dir):
    """A table with long fields, quotes and line breaks as tab-separated text, its rows counted on the way, and read back."""
    path, docs = fresh(spark, "tsv"), table(spark, sf_dir, "documents").select("doc_id", "text")
    written = tables.write_tsv(docs, path)
    read = tables.read_tsv(spark, path, "doc_id string, text string")
    longest = docs.agg((F.max(F.char_length("text")) > 4000).alias("was_cut"))
    return read.agg(F.lit(written).cast("long").alias("written"), F.count("*").alias("read"), F.sum(F.char_length("text")).alias("chars")).crossJoin(longest)


@query("SELECT l_orderkey AS show_url, string_agg(l_partkey || ':' || l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS rows FROM lineitem GROUP BY l_orderkey")
def rows_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("show_url"), "l_linenumber", "l_partkey", "l_returnflag")
    found = catalog.grouped(rows, "show_url", "l_linenumber")
    return found.select("show_url", F.array_join(F.transform("rows", lambda x: F.concat_ws(":", x["l_partkey"], x["l_returnflag"])), " ").alias("rows"))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /de/ # no\nDisallow: /es/\nAllow: /de/7\nDisallow:\n"


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p FROM pages) SELECT page_id, NOT starts_with(p, '/es/') AND (NOT starts_with(p, '/de/') OR starts_with(p, '/de/7')) AS allowed FROM p")
def robots_filter(spark, sf_dir):
    disallowed, permitted = urls.robots_rules(ROBOTS, "showloom")
    return table(spark, sf_dir, "pages").select("page_id", urls.allowed(F.col("url"), disallowed, permitted).alias("allowed"))


@query("SELECT true AS listed, count(*) FILTER (o_orderkey % 2 = 0) AS pages, 0 AS keywords FROM orders")
def dump_chunks(spark, sf_dir):
    """The files of a dump, the chunk that each page is from, and a list of keywords that isn't there."""
    from showloom.plans.shows import wiki_pages

    folder = fresh(spark, "dump")
    pages = wiki_pages(spark, sf_dir).select(F.col("page_id").alias("id"), "title", F.struct(F.struct(F.col("raw_text").alias("_VALUE")).alias("text")).alias("revision"))
    pages.write.format("xml").options(rootTag="mediawiki", rowTag="page").save(folder)
    files = tables.list_files(spark, f"{folder}/part-*").select(F.element_at(F.split("path", "/"), -1).alias("chunk"))
    read = tables.read_dump(spark, f"{folder}/part-*").groupBy("chunk").agg(F.count("*").alias("n"))
    none = len(tables.read_keywords(spark, f"{folder}/no-such-file"))
    both = files.withColumn("file", F.lit(True)).join(read, "chunk", "right")
    return both.agg(F.bool_and(F.coalesce("file", F.lit(False))).alias("listed"), F.sum("n").alias("pages"), F.lit(none).alias("keywords"))


@query("SELECT 4 AS modes, count(DISTINCT doc_id) * 4 AS norms FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text || ' ' || lang || ' ' || source), '[a-z0-9]+')) AS term FROM documents)")
def index_files(spark, sf_dir):
    """The saved index has a norm of each document for each idf mode."""
    return index(spark, sf_dir, MODES).stored.agg(F.countDistinct("idf_mode").cast("int").alias("modes"), F.count("*").alias("norms"))


@query(
    "SELECT p_partkey, CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN 'http://site.example/b' || p_partkey WHEN 1 THEN 'http://site.example/x/y' || p_partkey || '?a=../b' WHEN 2 THEN 'http://site.example/' || p_partkey || '/' WHEN 3 THEN 'http://other.example/a/../' || p_partkey "
    "WHEN 4 THEN 'http://site.example/..' || p_partkey ELSE 'http://site.example/p' || p_partkey || '.html#./z' END AS url FROM part"
)
def url_resolve_dots(spark, sf_dir):
    """Links with dot segments; those with a host of their own, and dots within names, stay."""
    key = F.col("p_partkey").cast("string")
    forms = [F.concat(F.lit("a/../b"), key), F.concat(F.lit("/x/./z/../y"), key, F.lit("?a=../b")), F.concat(F.lit("../../"), key, F.lit("/c/..")), F.concat(F.lit("http://other.example/a/../"), key), F.concat(F.lit(".."), key), F.concat(F.lit("./p"), key, F.lit(".html#./z"))]
    link = F.get(F.array(*forms), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.resolve_exactly(link, "http://site.example/").alias("url"))
