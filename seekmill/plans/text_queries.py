"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekmill.functions import dates, html, identity, robots, snippet, text as T, tokenizers, urls, wikitext
from seekmill.operators import clustering, routing
from seekmill.plans import sql as Q
from seekmill.plans.registry import query, table
from seekmill.sources import files

DOC_WORDS = f"(SELECT doc_id, {Q.words(Q.norm('text'))} AS ws FROM documents)"


@query("b1_normalize", f"SELECT doc_id, md5({Q.norm('text')}) AS digest, strlen({Q.norm('text')})::BIGINT AS bytes FROM documents")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    n = T.normalize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(n).alias("digest"), F.octet_length(n).cast("bigint").alias("bytes"))


@query("b2_content_hash", f"SELECT doc_id, sha256({Q.norm('text')}) AS content_hash FROM documents")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", identity.content_hash(F.col("text")).alias("content_hash"))


@query("b3_grams", f"SELECT doc_id, len(g)::BIGINT AS n, md5(array_to_string(g, '|')) AS digest FROM (SELECT doc_id, {Q.GRAMS} AS g FROM {DOC_WORDS})")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select("doc_id", T.words(T.normalize(F.col("text"))).alias("w"))
    return w.select("doc_id", T.grams(F.col("w")).alias("g")).select("doc_id", F.size("g").cast("bigint").alias("n"), F.md5(F.array_join("g", "|")).alias("digest"))


SIM_SQL = f"SELECT d.doc_id, coalesce(s.simhash, 0) AS simhash FROM documents d LEFT JOIN ({Q.simhash(DOC_WORDS, 'doc_id')}) s USING (doc_id)"


@query("b4_simhash", SIM_SQL)
def b4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", identity.simhash(F.col("text")).alias("simhash"))


@query("b5_content_id", f"SELECT doc_id, printf('%016x', simhash) AS content_id, simhash AS parsed FROM ({SIM_SQL})")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").select("doc_id", identity.content_id(identity.simhash(F.col("text"))).alias("content_id"))
    return c.withColumn("parsed", identity.parse_content_id(F.upper("content_id")))


@query("b6_hamming", f"SELECT doc_id, bit_count(xor(simhash, lag(simhash) OVER (PARTITION BY lang ORDER BY doc_id)))::INT AS distance FROM ({SIM_SQL}) JOIN documents USING (doc_id)")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("doc_id", "lang", identity.simhash(F.col("text")).alias("s"))
    before = F.lag("s").over(Window.partitionBy("lang").orderBy("doc_id"))
    return s.select("doc_id", identity.hamming(F.col("s"), before).cast("int").alias("distance"))


RAW_WORDS = f"(SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '{Q.S}+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM documents)"


@query("b7_raw_simhash", f"SELECT d.doc_id, coalesce(s.simhash, 0) AS simhash FROM documents d LEFT JOIN ({Q.simhash(RAW_WORDS, 'doc_id')}) s USING (doc_id)")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", identity.simhash(F.col("text"), raw=True).alias("simhash"))


@query("b8_fast_hash")
def b8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", identity.fast_hash(F.col("text")).alias("h"))


@query("b9_cosine", f"WITH f AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1) SELECT vec_id, CASE WHEN abs({Q.cosine('embedding', 'e')}) < 0.0000005 THEN 0 ELSE round({Q.cosine('embedding', 'e')}, 6) END AS cosine FROM embeddings JOIN f USING (label)")
def b9(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return v.join(first, "label").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("e")), 6).alias("cosine"))


def _rounded(v):
    return F.transform(v, lambda x: F.round(x, 5))


@query("b10_unit", f"SELECT vec_id, list_transform({Q.unit('list_transform(embedding, lambda x: x::DOUBLE * 3)')}, lambda x: CASE WHEN round(x, 5) = 0 THEN 0 ELSE round(x, 5) END) AS v FROM embeddings")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", _rounded(T.unit(F.transform("embedding", lambda x: x.cast("double") * 3))).alias("v"))


@query("b11_truncate_dims", f"SELECT vec_id, list_transform({Q.unit('embedding[1:16]')}, lambda x: CASE WHEN round(x, 5) = 0 THEN 0 ELSE round(x, 5) END) AS v FROM embeddings")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", _rounded(T.truncate_dims(F.col("embedding"), 16)).alias("v"))


@query(
    "b12_hash_embedding",
    f"""WITH h AS (SELECT doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
    e AS (SELECT doc_id, list_transform(range(8), lambda i: ((h + i) % 1000) / 500.0 - 1.0) AS v FROM h)
    SELECT doc_id, list_transform({Q.unit("v")}, lambda x: CASE WHEN round(x, 5) = 0 THEN 0 ELSE round(x, 5) END) AS v FROM e""",
)
def b12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", _rounded(T.hash_embedding(F.col("text"), 8)).alias("v"))


@query("b13_truncate", "SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, list_max(list_filter(range(0, 101), lambda k: strlen(left(text, k)) <= 100))) || '...' END AS cut FROM documents")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.truncate_bytes(F.col("text"), 100).alias("cut"))


TOKENS_SQL = f"""
coalesce(ceil(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '{Q.WORD.replace("'", "''")}'), lambda w:
  len(regexp_extract_all(w, '{Q.CJK}')) * 10 + CASE WHEN length(w) > len(regexp_extract_all(w, '{Q.CJK}')) THEN 10 + least(length(w) - len(regexp_extract_all(w, '{Q.CJK}')), 10) ELSE 0 END)) / 10.0), 0)::BIGINT"""


@query("b14_heuristic_tokens", f"SELECT doc_id, {TOKENS_SQL} AS n_tokens FROM documents")
def b14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tokenizers.token_count(F.col("text")).alias("n_tokens"))


#: A file of BPE ranks; it must lie there on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("b15_bpe_tokens")
def b15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tokenizers.token_count(F.col("text"), "bpe", RANKS).alias("n_tokens"))


@query("b16_tokenizer_resolution", "SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'cl100k_base' ELSE 'heuristic' END AS encoding FROM documents")
def b16(spark: SparkSession, sf: str) -> DataFrame:
    """The encoding that stands for a model's name, here one of the family for sources src1..., an unknown one else."""
    known, unknown = tokenizers.resolve(model="text-embedding-3-small"), tokenizers.resolve(model="another")
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("source").startswith("src1"), known).otherwise(unknown).alias("encoding"))


@query("b17_normalize_url", f"SELECT page_id, {Q.norm_url('url')} AS norm_url FROM pages")
def b17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("norm_url"))


@query(
    "b18_crawl_trap",
    rf"""WITH v AS (SELECT page_id, k, url || CASE k WHEN 0 THEN '' WHEN 1 THEN '/2024/01/02' WHEN 2 THEN '/a/b/a/b/a/b/c' ELSE repeat('/x', 16) END AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages), range(4) t(k)),
    s AS (SELECT *, list_filter(string_split({Q.path("url")}, '/'), lambda x: x <> '') AS s FROM v)
    SELECT page_id, k::INT AS k, strlen(url) > 2048 OR len(s) > 15 OR regexp_matches('/' || array_to_string(s, '/') || '/', '/[0-9]{{1,10}}/[0-9]{{1,10}}/[0-9]{{1,10}}/')
      OR (len(s) >= 4 AND len(list_filter(range(1, len(s) // 2 + 1), lambda w: len(list_filter(range(1, len(s) - w + 1), lambda i: s[i] = s[i + w])) >= 3)) > 0) AS trap FROM s""",
)
def b18(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    tail = F.when(k == 0, "").when(k == 1, "/2024/01/02").when(k == 2, "/a/b/a/b/a/b/c").otherwise("/x" * 16)
    v = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"), F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    return v.withColumn("url", F.concat("u", tail)).select("page_id", "k", urls.is_crawl_trap(F.col("url")).alias("trap"))


@query("b19_listing", f"SELECT page_id, {Q.listing('url')} AS listing FROM pages")
def b19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.is_listing(F.col("url")).alias("listing"))


@query("b20_priority", f"SELECT page_id, round(1.2::DOUBLE - 0.1::DOUBLE * (page_id % 5) + 0.2::DOUBLE * least(page_id % 13, 10) + CASE WHEN page_id % 2 = 0 THEN 0.5 ELSE 0 END - CASE WHEN {Q.listing('url')} THEN 0.5 ELSE 0 END, 6) AS priority FROM pages")
def b20(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    return table(spark, sf, "pages").select("page_id", F.round(urls.priority(p % 5, p % 13, p % 2 == 0, urls.is_listing(F.col("url"))), 6).alias("priority"))


@query("b21_aggregator_score")
def b21(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "pages").withColumn("x", html.extract(F.col("html"), F.col("url")))
    return x.select("page_id", F.round(html.aggregator_score(F.col("x")), 3).alias("score"))


@query("b22_main_text")
def b22(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "pages").withColumn("x", html.extract(F.col("html"), F.col("url")))
    return x.select("page_id", "x.text", "x.main_bytes", F.size("x.links").alias("n_links"))


@query("b24_page_metadata")
def b24(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract_pages(table(spark, sf, "pages")).drop("content", "links")


@query(
    "b26_parse_date",
    "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 0 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END AS parsed FROM events",
)
def b26(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 6
    spelt = F.when(k == 0, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("t", "yyyy/MM/dd")).when(k == 2, F.date_format("t", "dd-MM-yyyy")).when(k == 3, F.date_format("t", "MMMM d, yyyy")).when(k == 4, F.date_format("t", "MMM d, yyyy")).otherwise("soon")
    return e.select("event_id", dates.parse_date(spelt).cast("timestamp_ntz").alias("parsed"))


@query(
    "b27_schema_type",
    """SELECT event_type, t AS name, CASE WHEN lower(t) IN ('article', 'newsarticle', 'blogposting', 'technicalarticle') THEN 'article' WHEN lower(t) IN ('video', 'videoobject') THEN 'video'
    WHEN lower(t) IN ('person', 'profilepage') THEN 'profile' WHEN lower(t) IN ('organization', 'localbusiness') THEN 'organization' ELSE lower(t) END AS kind
    FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(['NewsArticle', 'VideoObject', 'Person', 'LocalBusiness', 'Recipe', 'Dataset']) AS t)""",
)
def b27(spark: SparkSession, sf: str) -> DataFrame:
    names = F.lit(["NewsArticle", "VideoObject", "Person", "LocalBusiness", "Recipe", "Dataset"])
    e = table(spark, sf, "events").select("event_type").distinct().select("event_type", F.explode(names).alias("name"))
    return e.withColumn("kind", html.schema_type(F.col("name")))


@query("b28_wikitext")
def b28(spark: SparkSession, sf: str) -> DataFrame:
    wiki = F.concat(F.lit("== "), F.col("source"), F.lit(" ==\n{{box|a={{b}}}}'''"), F.col("lang"), F.lit("''' [[Page|label]] [[File:x.png|thumb]]<ref>no</ref>\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", wikitext.wikitext_to_text(wiki).alias("plain"))


@query("b29_snippet")
def b29(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", snippet.snippet(F.lit("thing ing hand"), F.col("text")).alias("snippet"))


@query(
    "b30_labels",
    f"""WITH w AS (SELECT source, unnest(list_transform(regexp_split_to_array(lower(text), '{Q.S}+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS w FROM documents),
    c AS (SELECT source, w, count(*) AS n FROM w WHERE strlen(w) >= 4 AND w NOT IN ({", ".join(f"'{x}'" for x in Q.LABEL_STOP_WORDS)}) GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS r FROM c)
    SELECT d.source AS cluster, coalesce(string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ' ORDER BY r), 'Uncategorized') AS label FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN t ON t.source = d.source AND r <= 2 GROUP BY 1""",
)
def b30(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("cluster"), F.col("text").alias("title"), F.lit("").alias("url"))
    return clustering.labels(d)


PATTERNS = ("/", "/fr/", "/*/8", "*.html$", "/en", "/de/$", "/a*b*c", "/fr/8*5")


@query(
    "b31_path_matches",
    rf"""SELECT page_id, p AS pattern, regexp_matches({Q.path("url")}, '^' || replace(regexp_replace(CASE WHEN p LIKE '%$' THEN left(p, -1) ELSE p END, '([.+?^${{}}()|\[\]\\])', '\\\1', 'g'), '*', '.*') || CASE WHEN p LIKE '%$' THEN '$' ELSE '' END) AS hit
    FROM pages, (SELECT unnest([{", ".join(f"'{p}'" for p in PATTERNS)}]) AS p)""",
)
def b31(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", urls.path(F.col("url")).alias("path"), F.explode(F.lit(list(PATTERNS))).alias("pattern"))
    return p.select("page_id", "pattern", robots.path_matches(F.col("path"), F.col("pattern")).alias("hit"))


@query("b32_parse_robots")
def b32(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host")).distinct()
    body = F.concat(F.lit("User-agent: *\nDisallow: /fr\n\nUser-agent: seekmill\nDisallow: /"), F.substring("host", 1, 2), F.lit("\nAllow: /en\nCrawl-delay: 2.5\n"))
    return hosts.select("host", robots.parse_robots(body, "seekmill/1.0").alias("r")).select("host", "r.*")


@query("b33_ring_hash", f"SELECT DISTINCT {Q.host('url')} AS host, ('0x' || substr(sha256({Q.host('url')}), 1, 15))::BIGINT AS h FROM pages")
def b33(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host")).distinct().withColumn("h", routing.ring_hash(F.col("host")))


@query("a3_base_url", "SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'https://de.wikipedia.org/wiki/' WHEN n_nationkey % 3 = 1 THEN 'https://simple.wikipedia.org/wiki/' ELSE 'https://en.wikipedia.org/wiki/' END || replace(n_name, ' ', '_') AS url FROM nation")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    f = F.concat(F.when(k == 0, "dewiki-").when(k == 1, "simplewiki-").otherwise("ptwiki-"), F.lit("latest.xml"))
    return table(spark, sf, "nation").select("n_name", F.concat(urls.wiki_base_url(f), F.regexp_replace("n_name", " ", "_")).alias("url"))


@query("a4_dump_format", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'wikimedia_xml' WHEN 1 THEN 'zim' WHEN 2 THEN 'warc' WHEN 3 THEN 'plain_text' END AS format FROM pages")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 5
    name = F.concat(F.lit("Dump"), F.col("page_id").cast("string"), F.when(k == 0, ".XML.bz2").when(k == 1, ".zim").when(k == 2, ".warc.gz").when(k == 3, ".md").otherwise(".exe"))
    return table(spark, sf, "pages").select("page_id", urls.dump_format(name).alias("format"))


@query("a7_content_type", f"SELECT page_id, CASE WHEN {Q.path('url')} LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches({Q.path('url')}, '\\.(txt|text|md|markdown|rst)$') THEN 'text' ELSE 'html' END AS by_url, CASE WHEN {Q.path('url')} LIKE '%.html' THEN 'html' END AS by_name FROM pages")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.content_type(url=F.col("url")).alias("by_url"), urls.content_type(name=urls.path(F.col("url"))).alias("by_name"))


@query(
    "a8_text_title",
    rf"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, trim(regexp_replace(unnest(ls), '^{Q.S}+|{Q.S}+$', '', 'g')) AS t FROM (SELECT doc_id, string_split(text, chr(10))[1:10] AS ls FROM documents)),
    ok AS (SELECT doc_id, i, CASE WHEN regexp_matches(t, '^# +.') THEN regexp_extract(t, '^# +(.+)$', 1) ELSE t END AS t FROM l WHERE regexp_matches(t, '^# +.') OR (strlen(t) BETWEEN 10 AND 200 AND NOT regexp_matches(t, '^(#|http|//|/\*)')))
    SELECT d.doc_id, arg_min(t, i) AS title FROM documents d LEFT JOIN ok USING (doc_id) GROUP BY 1""",
)
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.text_title(F.col("text")).alias("title"))


@query("a10_html_documents")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return files.html_documents(table(spark, sf, "pages"))


@query("a15_links")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "pages").withColumn("x", html.extract(F.col("html"), F.col("url")))
    return x.select("page_id", F.posexplode("x.links").alias("n", "link"))


JS_HINTS = ("window.__NEXT_DATA__", "window.__NUXT__", "ng-app", "ng-controller", '<div id="root"></div>', '<div id="app"></div>', "data-reactroot")


@query(
    "a16_needs_js",
    f"""SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '{Q.S}', '', 'g')) < strlen(html) * 0.1 OR {" OR ".join(f"contains(html, '{h}')" for h in JS_HINTS)}
    OR ((contains(html, 'Loading...') OR contains(html, 'Please wait')) AND strlen(html) < 5000) AS needs_js FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '<div id="root"></div>' ELSE html END AS html FROM pages)""",
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 7 == 0, '<div id="root"></div>').otherwise(F.col("html")))
    return p.select("page_id", html.needs_js(F.col("html")).alias("needs_js"))
