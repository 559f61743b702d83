"""Page tables: one row per page with (doc_no, idx, filename, page, content), and what is assembled from them.

Order is carried by (doc_no, idx) everywhere; nothing depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip
from . import budget as B

#: Ids in a block of document numbers.
BLOCK = 4096


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, source, doc_no): documents number from 1 within their bundle, by ids.

    In two levels, so that a bundle with a third of all documents is many
    blocks: places within a block of ids, and the sums of the blocks before.
    """
    ids = docs.select(F.col(id_col), "source", F.coalesce(F.floor(F.col(id_col) / F.lit(BLOCK)), F.lit(-(1 << 62))).alias("block")).distinct()
    blocks = ids.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("source").alias("source_"), F.col("block").alias("block_"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "block").orderBy(id_col))
    met = ids.withColumn("place", place).join(blocks, F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("block_")))
    return met.select(id_col, "source", (F.col("place") + F.col("before")).cast("int").alias("doc_no"))


def split_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A page per line of a text; documents number within their bundle (``source``)."""
    # Documents meet their numbers before they are split: texts move once, and a document of two bundles is two.
    known = numbered(docs, id_col).select(F.col(id_col).alias("id_"), F.col("source").alias("source_"), "doc_no")
    met = docs.select(id_col, "source", F.col(text_col).alias("text_")).join(known, (F.col(id_col) == F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")))
    lines = met.select(F.col(id_col), "source", "doc_no", F.posexplode(F.split("text_", "\n")).alias("pos", "content"))
    return lines.select(id_col, (F.col("pos") + 1).alias("idx"), (F.col("pos") + 1).alias("page"), F.concat(F.lit("doc_"), F.col(id_col).cast("string")).alias("filename"), "content", "source", "doc_no")


def page_lines(docs: DataFrame) -> DataFrame:
    """The pages of documents without their bundles: no shuffle."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content")).select("doc_id", (F.col("pos") + 1).alias("idx"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"), (F.col("pos") + 1).alias("page"), "content")


def document_stats(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.char_length("content")).cast("long").alias("n_chars"))


def _joined(parts: Column, order: list[str], between: str) -> Column:
    """``parts`` of a group in the order of ``order``, as one string; null parts are left out."""
    kept = F.array_sort(F.collect_list(F.when(parts.isNotNull(), F.struct(*order, parts.alias("part_")))))
    return F.array_join(F.transform(kept, lambda x: x["part_"]), between)


def get_pages(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Pages of a request's own bundle for ``doc-page`` references (request, pos, ref), the first of each; malformed and unknown ones are left out."""
    parts = F.split("ref", "-")
    asked = refs.select("request", "pos", F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(1)).try_cast("int")).alias("doc_"), F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)).try_cast("int")).alias("page_"))
    asked = asked.where("doc_ is not null and page_ is not null")
    met = asked.join(pages, (F.col("request") == F.col("source")) & (F.col("doc_") == F.col("doc_no")) & (F.col("page_") == F.col("page")))
    first = F.row_number().over(Window.partitionBy("request", "pos").orderBy("idx"))
    return met.withColumn("rn_", first).where("rn_ = 1").drop("rn_", "doc_", "page_")


def keyword_filter(pages: DataFrame, words: list[str], fold: bool = True, most: int = 500) -> DataFrame:
    """Pages that contain any word, numbered anew in their document, contents cut to a preview."""
    text = F.lower("content") if fold else F.col("content")
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w.lower() if fold else w)
    found = pages.where(hit)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return found.select("doc_id", number.alias("idx"), "page", F.concat(F.left("content", F.lit(most)), F.lit("...")).alias("content"))


def pick_page(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """For (doc_id, want): the page of that number, else the want-th page."""
    by_page = pages.groupBy("doc_id", "page").agg(F.min_by("content", "idx").alias("by_page")).withColumnRenamed("page", "want")
    by_place = pages.select("doc_id", F.col("idx").alias("want"), F.col("content").alias("by_place"))
    return asked.join(by_page, ["doc_id", "want"], "left").join(by_place, ["doc_id", "want"], "left").select("doc_id", "want", F.coalesce("by_page", "by_place").alias("content"))


def concat_pages(pages: DataFrame, key: str, head: Column, order: list[str], between: str, most: int | None = None) -> DataFrame:
    """The pages of a key as one text, each after its head."""
    text = _joined(F.concat(head, F.col("content")), order, between)
    return pages.groupBy(key).agg((F.left(text, F.lit(most)) if most else text).alias("body"))


def context_preview(pages: DataFrame, n: int = 3, most: int = 500) -> DataFrame:
    """``File``, then the beginnings of the first pages."""
    few = pages.where(F.col("idx") <= n)
    body = _joined(F.left("content", F.lit(most)), ["idx"], "\n")
    return few.groupBy("doc_id", "filename").agg(F.concat(F.lit("File: "), F.first("filename"), F.lit("\n"), body, F.lit("...")).alias("preview")).drop("filename")


def doc_summary(pages: DataFrame, most: int = 1000) -> DataFrame:
    head = F.concat(F.lit("Document: "), F.col("filename"), F.lit("\nTotal pages: "), F.count(F.lit(1)).cast("string"), F.lit("\n\n"))
    body = _joined(F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), clip("content", most)), ["idx"], "\n")
    return pages.groupBy("doc_id", "filename").agg(F.concat(head, body).alias("summary")).drop("filename")


def evidences(pages: DataFrame) -> DataFrame:
    """(doc_id, page, context): content, else context, else html_context, else empty; pages without a number take their place."""
    names = [c for c in ("content", "context", "html_context") if c in pages.columns]
    return pages.select("doc_id", "idx", F.coalesce("page", "idx").alias("page"), F.coalesce(*[F.col(c) for c in names], F.lit("")).alias("context"))


def budget_pieces(pages: DataFrame, key: str, most: int = 80000, least: int = 100, measure: Column | None = None) -> DataFrame:
    """(bundle, doc_no, idx, piece): labelled pages of all documents of a key within a budget, a row each.

    A page that doesn't fit is clipped (if over ``least`` remains) and ends
    its document; the clipped piece doesn't use up the budget, so each later
    document may add one. ``measure`` counts a chunk (column ``chunk``), its
    characters by default; clipping is by characters.
    """
    return _budget_pieces(pages, key, most, least, measure, False)


def _budget_pieces(pages: DataFrame, key: str, most: int, least: int, measure: Column | None, all_bundles: bool) -> DataFrame:
    chunk = F.concat(F.lit("[Doc"), F.col("doc_no").cast("string"), F.lit(" Page"), F.col("page").cast("string"), F.lit("] "), F.coalesce("content", F.lit("")))
    rows = pages.select(F.col(key).alias("bundle"), "doc_no", "idx", chunk.alias("chunk"))
    size = F.char_length("chunk") if measure is None else measure
    return B.pieces(rows, B.Rule(most, least), F.col("chunk"), size, lambda rest: F.concat(F.left("chunk", rest), F.lit("...")), all_bundles=all_bundles)


def truncate(pages: DataFrame, key: str, most: int = 80000, least: int = 100, measure: Column | None = None) -> DataFrame:
    """(key, body): ``budget_pieces`` of a key as one text."""
    return B.joined(_budget_pieces(pages, key, most, least, measure, True)).withColumnRenamed("bundle", key)


def gather_sources(pages: DataFrame, key: str, most: int = 12000, least: int = 200, n_pages: int = 12) -> DataFrame:
    """(key, body): the first ``n_pages`` pages of each document that aren't empty, within a budget of their contents' characters.

    Heads cost nothing and aren't clipped; they show a page number if pages
    have one as ``page_num``, else a question mark. A bundle without such
    pages has an empty body.
    """
    number = F.coalesce(F.col("page_num").cast("string"), F.lit("?")) if "page_num" in pages.columns else F.lit("?")
    head = F.concat(F.lit("[Doc "), F.col("doc_no").cast("string"), F.lit(", p."), number, F.lit("]\n"))
    rows = pages.where((F.col("idx") <= n_pages) & (F.coalesce("content", F.lit("")) != "")).select(F.col(key).alias("bundle"), "doc_no", "idx", head.alias("head"), "content")
    taken = B.pieces(rows, B.Rule(most, least), F.concat("head", "content"), F.char_length("content"), lambda rest: F.concat("head", F.left("content", rest), F.lit("...")))
    return B.joined(taken, pages.select(F.col(key).alias("bundle")).distinct()).withColumnRenamed("bundle", key)


def base_format(pages: DataFrame) -> DataFrame:
    """(bundle, filename_k, n_pages_k, text_k): two documents of each bundle side by side."""
    two = pages.where("doc_no <= 2").groupBy("source", "doc_no").agg(F.first("filename").alias("filename"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("string"), "content")))).alias("text"))
    side = lambda k, c: F.max(F.when(F.col("doc_no") == k, F.col(c)))
    pick = lambda k: F.first(F.when(F.col("doc_no") == k, F.col("text")), ignorenulls=True)
    return two.groupBy("source").agg(side(1, "filename").alias("filename_1"), pick(1).alias("text_1"), side(2, "filename").alias("filename_2"), pick(2).alias("text_2"))
