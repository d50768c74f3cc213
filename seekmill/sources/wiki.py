"""Wiki dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.functions import urls, wikitext

PAGE = (
    "title string, ns int, id bigint, redirect struct<_title:string>, "
    "revision struct<id:bigint, timestamp:string, text:struct<_VALUE:string>>"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A1: page elements of plain or bz2 XML, in parallel (bz2 can be split); the page's own id, not the revision's."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return raw.select("file", "id", F.coalesce("ns", F.lit(0)).alias("ns"), "title", F.col("redirect").isNotNull().alias("redirect"), F.col("revision.text._VALUE").alias("wikitext"), F.try_to_timestamp(F.col("revision.timestamp")).alias("modified"))


def page_documents(pages: DataFrame, namespaces: tuple[int, ...] | None = (0,), min_raw: int = 100, min_text: int = 50, strict: bool = False) -> DataFrame:
    """A2, A3: documents of pages of these namespaces (None: all), without redirects, without title, id or text, or too short ones."""
    ok = F.col("title").isNotNull() & F.col("id").isNotNull() & F.col("wikitext").isNotNull() & ~F.col("redirect") & (F.octet_length("wikitext") >= min_raw)
    if namespaces is not None:
        ok = ok & F.col("ns").isin(*namespaces)
    text = pages.filter(ok).withColumn("content", wikitext.wikitext_to_text(F.col("wikitext"), strict)).filter(F.octet_length("content") >= min_text)
    url = F.concat(urls.wiki_base_url(F.col("file")), F.regexp_replace("title", " ", "_"))
    return text.select(F.col("id").cast("string").alias("id"), "title", "content", url.alias("url"), "modified", F.create_map(F.lit("namespace"), F.col("ns").cast("string")).alias("metadata"))
