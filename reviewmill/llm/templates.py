"""Main text of web pages, without the site's templates.

Every page is read once: hashes of the element subtrees of the whole page, and text blocks with
the hashes of the subtrees around them. Spark counts per host on how many different pages a
subtree occurs; one that recurs on ``MIN_PAGES`` or more is the site's, however large the host is, and
goes first. Of what is left, a page that marks its article gives the article alone, another one
all its text; elements that never belong to an article (menus, footers, side bars, forms, scripts,
marked adverts, notices and reader comments) are left out of both. A box that the site shows as an
article on all its pages is so no article. Inside an article only boxes such as div or section
can be templates: a paragraph that many articles share is text.

Equal pages count as one, so that copies of a page do not turn its content into a template. Only
(host, page hash, subtree hash) rows are shuffled, combined before.

Defined results: null or empty html gives an empty text. A null url is a host of its own. Ids
play no part; repeated pages are answered each. References are decoded; white space is what
Python's ``str.split`` takes for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, query, table, whole_text
from .html_tree import read_page

MIN_PAGES = 5  # different pages of a host on which a template occurs, at least
READ = "page_hash long, subtrees array<long>, blocks array<struct<text:string,main:boolean,path:array<long>>>"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = []
        for html in pages:
            known_by, subtrees, blocks = read_page(html)
            rows.append((known_by, subtrees, [{"text": t, "main": m, "path": p} for t, m, p in blocks]))
        yield pd.DataFrame(rows, columns=["page_hash", "subtrees", "blocks"])


def site_templates(read: DataFrame) -> DataFrame:
    """(host, subtree) of all templates among read pages (host, page_hash, subtrees)."""
    found = read.select("host", "page_hash", F.explode("subtrees").alias("subtree")).distinct()
    n = found.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= MIN_PAGES).select("host", "subtree")


def read_pages(pages: DataFrame, keep: Column, html: str = "html", url: str = "url") -> DataFrame:
    """(page: ``keep``, host, page_hash, subtrees, blocks, row), one row per page."""
    return pages.select(
        keep.alias("page"), host_of(F.col(url)).alias("host"),
        F.pandas_udf(_read, READ)(whole_text(html)).alias("read"),
    ).select("page", "host", "read.*", F.monotonically_increasing_id().alias("row"))


def extract_main_text(pages: DataFrame, out: str = "text", html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without ``html`` and with the main text in ``out``."""
    given = [c for c in pages.columns if c != html and c != out]
    read = cut_lineage(read_pages(pages, F.struct(*[F.col(f"`{c}`") for c in given]), html, url))
    # Only a page with a block inside a subtree that could be a template has anything to lose by
    # the counts; the texts of the others are not shuffled.
    boxed = F.exists("blocks", lambda b: F.size(b["path"]) > 0)
    paths = F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["path"])))
    inside = read.where(boxed).select("row", "host", F.explode(paths).alias("subtree"))
    gone = inside.join(site_templates(read), ["host", "subtree"]).groupBy("row").agg(
        F.collect_set("subtree").alias("gone")
    )
    several = read.where(boxed).join(gone, "row", "left").select("page", "blocks", "gone")
    plain = read.where(~boxed).select("page", "blocks", F.lit(None).cast("array<long>").alias("gone"))
    stays = F.filter("blocks", lambda b: F.col("gone").isNull() | ~F.arrays_overlap(b["path"], "gone"))
    article = F.filter("stays", lambda b: b["main"])
    chosen = F.when(F.size(article) > 0, article).otherwise(F.col("stays"))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), " ")
    (main,) = fresh(pages, "main_text")
    whole = plain.unionByName(several).select("page", stays.alias("stays")).select("page", text.alias(main))
    return whole.select("page.*", main).withColumnRenamed(main, out)


@query()
def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
