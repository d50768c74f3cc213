"""Files and fetched pages as documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.functions import html as H, text as T, urls


def read_files(spark: SparkSession, path: str, concat: bool = False) -> DataFrame:
    """(path, kind, content, title) of the text, Markdown and HTML files below a folder, files that aren't UTF-8 left out;
    concat=True makes one document of them, in the order of their paths."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = urls.content_type(F.col("path"))
    docs = raw.withColumn("kind", kind).filter(F.col("kind").isin("text", "html")).filter(F.is_valid_utf8(F.col("content").cast("string")))
    docs = docs.select("path", "kind", F.col("content").cast("string").alias("content"))
    if concat:
        parts = docs.agg(F.array_sort(F.collect_list(F.struct("path", "content"))).alias("p"))
        docs = parts.select(F.lit(path).alias("path"), F.lit("text").alias("kind"), F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("content"))
    return docs.withColumn("title", T.text_title(F.col("content")))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A4, A5: dispatch on a dump's name; ZIM and WARC are known formats without a reader."""
    from seekmill.sources import wiki

    low = path.lower()
    if low.endswith((".xml", ".xml.bz2")):
        return wiki.page_documents(wiki.read_pages(spark, path))
    if low.endswith((".zim", ".warc", ".warc.gz")):
        raise NotImplementedError(f"no reader for {path}")
    return read_files(spark, path)


def clean_pdf_text(text: Column) -> Column:
    """Lines trimmed, runs of blank lines made one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"^{T.SPACE}+|{T.SPACE}+$", ""))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def pdf_title(text: Column) -> Column:
    """Of the first 5 lines that aren't blank the first of 10 to 200 bytes that is neither an address nor a number."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 5)
    return F.try_element_at(F.filter(lines, lambda x: F.octet_length(x).between(10, 200) & ~x.rlike(r"^(http|www)|^[\d\s.,/-]+$")), F.lit(1))


def extract_pdf(files: DataFrame, extractor: Callable[[bytes], str], content_col: str = "content") -> DataFrame:
    """Files with text and title; extractor turns a PDF's bytes to text. Files without text are left out."""
    kept = [f for f in files.schema if f.name != content_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=content_col).assign(text=[extractor(bytes(b)) for b in pdf[content_col]])

    out = files.mapInPandas(run, schema).withColumn("text", clean_pdf_text(F.col("text"))).filter("text <> ''")
    return out.withColumn("title", pdf_title(F.col("text")))


def fetch(targets: DataFrame, fetcher: Callable[[str], tuple[int, str, str, str]], max_bytes: int = 10 << 20, per_task: int = 64) -> DataFrame:
    """Pages of targets(url); fetcher gives (status, final URL, MIME type, body) of a URL. Errors are kept as rows with status 0;
    other types than HTML and plain text, and bodies over max_bytes, come without a body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    status, final, mime, body = fetcher(url)
                    fits = mime.split(";")[0].strip() in ("text/html", "application/xhtml+xml", "text/plain") and len(body.encode()) <= max_bytes
                    rows.append((url, final, status, mime, body if fits else None, None))
                except Exception as e:  # noqa: BLE001  (a failed page must not fail the crawl)
                    rows.append((url, url, 0, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "mime", "body", "error"])

    spread = targets.select("url").repartition(max(1, -(-targets.count() // per_task)))  # tasks of about per_task URLs
    return spread.mapInPandas(run, "url string, final_url string, status int, mime string, body string, error string")


def html_documents(pages: DataFrame) -> DataFrame:
    """A10: (url, content, title) of pages(url, html); a missing or broken URL stands for localhost."""
    x = H.extract(F.col("html"), F.col("url"))
    return pages.withColumn("_x", x).select("url", F.col("_x.text").alias("content"), F.coalesce("_x.title_tag", "_x.h1").alias("title"))
