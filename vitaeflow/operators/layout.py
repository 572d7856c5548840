"""Reading order of text blocks on pages with one or two columns.

Blocks: (doc_key, page, x0, y0, x1, y1, text, kind, width); kind 0 is text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaeflow.functions.text import pdf_cleanup, strip

MIN_BLOCKS = 4
MIN_COLUMN_SHARE = 0.25
PAGE_BREAK = "\n\n---\n\n"


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks with whether their page is dual and whether they stand in its right column."""
    text = blocks.filter((F.col("kind") == 0) & (strip(F.col("text")) != ""))
    page = Window.partitionBy("doc_key", "page")
    right = ((F.col("x0") + F.col("x1")) / 2 >= F.col("width") * 0.5).cast("int")
    share = F.avg("is_right").over(page)
    dual = (F.count("*").over(page) >= MIN_BLOCKS) & (share >= MIN_COLUMN_SHARE) & (1 - share >= MIN_COLUMN_SHARE)
    return text.withColumn("is_right", right).withColumn("dual", dual).withColumn("column", F.when(F.col("dual"), F.col("is_right")).otherwise(0))


def page_texts(blocks: DataFrame) -> DataFrame:
    """(doc_key, page, dual, text): blocks by column, then from top to bottom. One shuffle."""
    item = F.struct("column", "y0", "x0", strip(F.col("text")).alias("text"))
    pages = placed_blocks(blocks).groupBy("doc_key", "page").agg(F.first("dual").alias("dual"), F.array_sort(F.collect_list(item)).alias("items"))
    side = lambda k: F.array_join(F.transform(F.filter("items", lambda x: x["column"] == k), lambda x: x["text"]), "\n\n")
    return pages.select("doc_key", "page", "dual", F.when(F.col("dual"), F.concat_ws("\n\n\n\n", side(0), side(1))).otherwise(side(0)).alias("text"))


def document_texts(blocks: DataFrame) -> DataFrame:
    """(doc_key, text): pages in order with rules between them."""
    pages = page_texts(blocks).filter(strip(F.col("text")) != "").groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return pages.select("doc_key", pdf_cleanup(F.array_join(F.transform("pages", lambda p: p["text"]), PAGE_BREAK)).alias("text"))
