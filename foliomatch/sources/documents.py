"""Pages and words from files: native text where there is some, else recognised text.

Opening a PDF, rendering it and recognising text need libraries that callers bring along: a pager maps a
file's bytes to pages, a recogniser an image to detections. What is done with their results is here.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomatch.config import CONFIG
from foliomatch.functions import patterns as P
from foliomatch.functions.text import blank
from foliomatch.sources.intermediate import written
from foliomatch.sources.workers import Factory, made

LOG = logging.getLogger(__name__)
PAGES = "path string, page_num int, width double, height double, native_text string, image binary"


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of the files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def document_id(path: Column) -> Column:
    """The file's name without its last extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def sized(pages_: DataFrame) -> DataFrame:
    """Pages (path, page_num, native_text) of text with width and height: a word's box is its place in the line and the line's number."""
    lines = F.split("native_text", "\n", -1)
    places = F.array_max(F.transform(lines, lambda x: F.size(F.regexp_extract_all(x, F.lit(P.TOKEN), F.lit(0)))))
    return pages_.select("path", "page_num", (places + 1).cast("double").alias("width"), (F.size(lines) + 1).cast("double").alias("height"), "native_text")


def text_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """path, page_num, native_text, width, height of the pages of UTF-8 text files, parted by form feeds; width and height are
    places and lines. A form feed at a file's very end begins no page; an empty file has none.

    Spark's reader cuts a file into blocks at any place and gives each its whole pages, so that one large file is many tasks, in
    any store that Spark reads. A page's number is its place in its block behind the pages of the blocks before."""
    rows = spark.read.option("lineSep", "\f").text(list(paths)).select(
        F.col("value").alias("native_text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    rows = written(rows, "text-pages")
    blocks = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("path", "block", before.alias("before"))
    place = F.row_number().over(W.partitionBy("path", "block").orderBy("row")) - 1
    numbered = rows.withColumn("place", place).join(blocks, ["path", "block"])
    return sized(numbered.select("path", (F.col("place") + F.col("before")).cast("int").alias("page_num"), "native_text"))


def pages(found: DataFrame, pager: Callable[[bytes], list[dict]]) -> DataFrame:
    """The pages of files (PAGES). A file that the pager can't open has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = pager(content)
                except Exception as e:  # the pager is the caller's code: whatever it raises costs one file
                    LOG.warning("%s can't be opened: %s", path, e)
                    rows = []
                yield pd.DataFrame([{"path": path, **r} for r in rows], columns=[c.split()[0] for c in PAGES.split(", ")])

    return found.select("path", "content").mapInPandas(run, PAGES)


def recognised(images: DataFrame, recogniser: Callable[[bytes], list[tuple]] | Factory) -> DataFrame:
    """Detections of page images; a page that fails has none. A factory makes the recogniser once a worker; its ways are tried in
    turn, as for a GPU and then the CPU."""
    schema = "path string, page_num int, det_no int, tlx double, tly double, trx double, try_ double, brx double, bry double, blx double, bly double, text string, prob double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = made(recogniser) if isinstance(recogniser, Factory) else recogniser
        for part in parts:
            for path, page, image in zip(part["path"], part["page_num"], part["image"], strict=True):
                try:
                    found = recognise(image)
                except Exception as e:  # the recogniser is the caller's code: whatever it raises costs one page
                    LOG.warning("page %s of %s can't be recognised: %s", page, path, e)
                    found = []
                yield pd.DataFrame([(path, page, i, *corners, text, prob) for i, (corners, text, prob) in enumerate(found)], columns=names)

    return images.select("path", "page_num", "image").mapInPandas(run, schema)


def detection_words(detections: DataFrame, threshold: float = CONFIG.ocr_confidence) -> DataFrame:
    """Detections (corners, text, prob, scale_x, scale_y) to words: sure and not blank ones, with the box
    around the corners in page points."""
    kept = detections.filter((F.col("prob") > threshold) & ~blank(F.col("text")))
    box = lambda f, a, b, s: (f(a, b) * F.col(s))
    return kept.select(
        "doc_id", "page_num", "det_no", box(F.least, "tlx", "blx", "scale_x").alias("x0"), box(F.least, "tly", "try_", "scale_y").alias("y0"),
        box(F.greatest, "trx", "brx", "scale_x").alias("x1"), box(F.greatest, "bly", "bry", "scale_y").alias("y1"), "text",
    )


def inside_page(words: DataFrame) -> DataFrame:
    """Native words whose box begins on the page and isn't empty."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return words.filter((x0 >= 0) & (x0 < F.col("page_w")) & (y0 >= 0) & (y0 < F.col("page_h")) & (x1 > x0) & (y1 > y0))


def page_source(counts: DataFrame, force_ocr: bool = CONFIG.force_ocr) -> DataFrame:
    """doc_id, page_num, source by the number of native words: recognised text if forced or if there are few."""
    few = F.coalesce(F.col("native_words"), F.lit(0)) < CONFIG.min_native_words
    return counts.select("doc_id", "page_num", F.when(F.lit(force_ocr) | few, "ocr").otherwise("native").alias("source"))


def page_words(native: DataFrame, detections: DataFrame, force_ocr: bool = CONFIG.force_ocr) -> DataFrame:
    """doc_id, page_num, pos, x0, y0, x1, y1, text: each page's words from its source. A page with fewer native words than
    the least has recognised words, or none; the others' native words must lie on the page.

    native: doc_id, page_num, pos, x0, y0, x1, y1, text, page_w, page_h; detections: as detection_words takes them."""
    box = ("x0", "y0", "x1", "y1", "text")
    recognised_ = detection_words(detections).select("doc_id", "page_num", F.col("det_no").alias("pos"), *box)
    if force_ocr:
        return recognised_
    pages_ = native.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("native_words"))
    pages_ = pages_.unionByName(detections.select("doc_id", "page_num", F.lit(0).cast("long").alias("native_words")).distinct())
    chosen = page_source(pages_.groupBy("doc_id", "page_num").agg(F.max("native_words").alias("native_words")), False)
    of = lambda df, kind: df.join(chosen.filter(F.col("source") == kind), ["doc_id", "page_num"], "left_semi")
    return of(inside_page(native), "native").select("doc_id", "page_num", "pos", *box).unionByName(of(recognised_, "ocr"))


def extracted_text(page_texts: DataFrame) -> DataFrame:
    """doc_id, extracted_text: each page's native text if not blank, else its recognised text, under a heading.
    A page without recognised text (null) is left out."""
    native = ~blank(F.col("native_text"))
    chunk = lambda kind, c: F.format_string(f"--- Page %d ({kind}) ---\n%s\n", F.col("page_num") + 1, F.col(c))
    text = F.when(native, chunk("Native", "native_text")).when(F.col("ocr_text").isNotNull(), chunk("EasyOCR", "ocr_text"))
    items = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("page_num", text.alias("t")))))
    return page_texts.groupBy("doc_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), "").alias("extracted_text"))
