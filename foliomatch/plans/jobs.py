"""Whole jobs: files into a catalog, documents against stored ones, two files against each other.

Files are opened by the caller's pager and recognised by the caller's recogniser (``sources.documents``);
``text_pager`` opens plain text. Each job is one set of distributed steps for any number of files or pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomatch.config import CONFIG
from foliomatch.functions import patterns as P
from foliomatch.functions.text import blank
from foliomatch.operators import compare, words
from foliomatch.plans import prompts
from foliomatch.sources import catalog, documents, index
from foliomatch.sources.intermediate import kept_large, large, written
from foliomatch.sources.workers import Factory

POINTS_PER_INCH = 72


def text_pager(content: bytes) -> list[dict]:
    """Pages of a UTF-8 text, parted by form feeds; width and height are places and lines. A file is one task's: for large ones
    there is ``documents.text_pages``, and ``ingest_texts``."""
    pages = content.decode("utf-8").removesuffix("\f").split("\f")
    lines = [p.split("\n") for p in pages]
    return [
        {"page_num": i, "width": 1.0 + max(len(x.split()) for x in ls), "height": 1.0 + len(ls), "native_text": p, "image": b""}
        for i, (p, ls) in enumerate(zip(pages, lines, strict=True))
    ]


def native_words(pages: DataFrame) -> DataFrame:
    """Words of native texts (doc_id, page_num, native_text, width, height) as ``documents.page_words`` takes them, whose
    boxes are places in lines. Callers whose pages have boxes pass their own words."""
    lines = pages.select("doc_id", "page_num", "width", "height", F.posexplode(F.split("native_text", "\n", -1)).alias("line_no", "line"))
    found = lines.select("doc_id", "page_num", "width", "height", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(P.TOKEN), F.lit(0))).alias("place", "text"))
    x, y = F.col("place").cast("double"), F.col("line_no").cast("double")
    # pos counts the page's words by line and place
    items = F.sort_array(F.collect_list(F.struct("line_no", "place", x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"), "text")))
    by_page = found.groupBy("doc_id", "page_num", F.col("width").alias("page_w"), F.col("height").alias("page_h")).agg(items.alias("ws"))
    out = by_page.select("doc_id", "page_num", "page_w", "page_h", F.posexplode("ws").alias("pos", "w"))
    return out.select("doc_id", "page_num", "pos", "w.x0", "w.y0", "w.x1", "w.y1", "w.text", "page_w", "page_h")


class Read(NamedTuple):
    """Files read: texts (doc_id, filename, extracted_text, page_count) and words (doc_id, page_num, pos, x0, y0, x1, y1, text)."""

    texts: DataFrame
    words: DataFrame


def read_files(found: DataFrame, pager: Callable, recogniser: Callable | None = None, custom_id: str | None = None, force_ocr: bool = CONFIG.force_ocr, native: DataFrame | None = None) -> Read:
    """Texts and words of files (path, content). doc_id is custom_id, if given, or the name without its extension.

    A file that can't be opened, or has no pages, has no row. Without a recogniser all words are native. Recognised
    boxes are scaled from the rendering's resolution to points. Files are opened and recognised once."""
    return _read(written(documents.pages(found, pager), "pages"), recogniser, custom_id, force_ocr, native)


def _read(pages: DataFrame, recogniser: Callable | None = None, custom_id: str | None = None, force_ocr: bool = CONFIG.force_ocr, native: DataFrame | None = None) -> Read:
    name = F.lit(custom_id) if custom_id else documents.document_id(F.col("path"))
    pages = pages.withColumn("doc_id", name)
    native = native_words(pages) if native is None else native
    if recogniser is None:
        seen, chosen = None, documents.inside_page(native).select("doc_id", "page_num", "pos", "x0", "y0", "x1", "y1", "text")
    else:
        scale = F.lit(POINTS_PER_INCH / CONFIG.ocr_dpi)
        seen = written(documents.recognised(pages, recogniser), "detections").withColumn("doc_id", name).withColumn("scale_x", scale).withColumn("scale_y", scale)
        chosen = documents.page_words(native, seen, force_ocr)
    texts = pages.select("doc_id", "path", "page_num", "native_text")
    if seen is None:
        texts = texts.withColumn("ocr_text", F.lit(None).cast("string"))
    else:
        said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("det_no", "text"))), lambda d: d["text"]), "\n")
        texts = texts.join(seen.groupBy("doc_id", "path", "page_num").agg(said.alias("ocr_text")), ["doc_id", "path", "page_num"], "left")
    filename = F.regexp_extract("path", r"([^/\\]*)$", 1)
    about = pages.groupBy("doc_id").agg(F.min(filename).alias("filename"), F.count_distinct("page_num").cast("int").alias("page_count"))
    return Read(documents.extracted_text(texts).join(about, "doc_id"), chosen)


class Tally(NamedTuple):
    stored: int
    failed: int


def ingest_files(store: catalog.Catalog, found: DataFrame, pager: Callable, recogniser: Callable | None = None, custom_id: str | None = None, **how) -> Tally:
    """Store files with their texts and word indexes; how many were stored and how many weren't. custom_id counts if there
    is exactly one file. Files of the same document_id are one document, whose pages mix: pass one of them."""
    total = found.select("path").distinct().count()
    return _ingest(store, read_files(found, pager, recogniser, custom_id if total == 1 else None, **how), total)


def ingest_texts(store: catalog.Catalog, *paths: str) -> Tally:
    """``ingest_files`` for UTF-8 text files of any size, read by Spark in blocks. Empty files aren't seen, nor counted."""
    return ingest_pages(store, documents.text_pages(store.spark, *paths))


def ingest_pages(store: catalog.Catalog, pages: DataFrame) -> Tally:
    """``ingest_files`` for pages that are there already (path, page_num, width, height, native_text)."""
    pages = written(pages, "pages")
    return _ingest(store, _read(pages), pages.select("path").distinct().count())


def _ingest(store: catalog.Catalog, got: Read, total: int) -> Tally:
    texts = written(got.texts, "ingest-texts")
    stored = texts.count()
    if stored:
        chosen = written(got.words, "ingest-words")
        catalog.ingest(store, texts, chosen)
    return Tally(stored, total - stored)


class Compared(NamedTuple):
    """What ``compare_words`` finds: words, a row a pair, boxes to mark."""

    found: DataFrame
    summary: DataFrame
    marks: DataFrame


def compare_words(pairs: DataFrame, all_words: DataFrame, mode: str = "diff", stored: bool = False, vocab: DataFrame | None = None) -> Compared:
    """Pairs (pair_id, doc1, doc2) of documents in all_words in either mode; stored: doc2 is a stored one. vocab: the words'
    vocabulary, if it is there already."""
    if mode not in ("diff", "same"):
        raise ValueError(f"mode is diff or same, not {mode!r}")
    vocab = kept_large(words.vocabulary(all_words) if vocab is None else vocab, "job-vocabulary")
    if mode == "diff":
        found = kept_large(compare.diff_words(pairs, all_words, vocab, stored), "job-found")
        return Compared(found, compare.diff_summary(pairs, all_words, vocab, stored, found), compare.highlights(found, all_words, mode))
    found = kept_large(compare.same_words(pairs, vocab, stored), "job-found")
    return Compared(found, compare.same_summary(pairs, all_words, vocab, stored, found), compare.highlights(compare.same_marks(found, pairs), all_words, mode))


def compare_with_catalog(pairs: DataFrame, doc_words: DataFrame, store: DataFrame, mode: str = "diff") -> Compared:
    """Documents against stored ones by the stored word indexes, which are read instead of the files: their words by page
    and, as their vocabulary, their entries by word.

    pairs: pair_id, doc_id (of doc_words), document_id (of the catalog's table `store`). In the result doc1 and doc2 are
    both texts, a document as ``file:`` and its id, a stored one as ``stored:`` and its id. Pairs whose stored document
    isn't there, or has no index, are compared with no words. Words of documents outside pairs change nothing, but callers
    do better to leave such documents out than this does by a join of all words."""
    own, kept = (lambda c: F.concat(F.lit("file:"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("stored:"), F.col(c)))
    pairs = pairs.select("pair_id", own("doc_id").alias("doc1"), kept("document_id").alias("doc2"), "document_id")
    indexed = large(store).join(compare.counted(pairs.select("document_id").distinct(), pairs), "document_id", "left_semi").select(kept("document_id").alias("doc_id"), "by_page", "by_word")
    mine = doc_words.withColumn("doc_id", own("doc_id")).select("doc_id", "page_num", "pos", "x0", "y0", "x1", "y1", "text")
    both = kept_large(mine.unionByName(index.words_of(indexed)), "catalog-words")
    vocab = words.vocabulary(both.filter(F.col("doc_id").startswith("file:"))).unionByName(index.vocabulary_of(indexed))
    return compare_words(pairs.select("pair_id", "doc1", "doc2"), both, mode, True, vocab)


def asked(pairs: DataFrame, texts: DataFrame, model: Callable[[str, int], str] | Factory, mode: str = "diff", language: str = "th", limits: prompts.Limits = prompts.Limits()) -> DataFrame:
    """pair_id, answer: what a model says about pairs (pair_id, doc1, doc2) of texts (doc_id, text) in a mode. Pairs of which a text is
    blank, or isn't there, aren't asked about and have no row."""
    there = texts.filter(~blank(F.col("text")))
    of = lambda n: there.select(F.col("doc_id").alias(f"doc{n}"), F.col("text").alias(f"text{n}"))
    both = pairs.join(of(1), "doc1").join(of(2), "doc2")
    questions = both.select(F.col("pair_id").alias("key"), prompts.compare(language=language, mode=mode).alias("prompt"))
    return prompts.answered(questions, model, prompts.COMPARE_TOKENS, limits).select(F.col("key").alias("pair_id"), "answer")


def catalog_texts(texts: DataFrame, store: DataFrame) -> DataFrame:
    """doc_id, text of documents and stored ones by the names that ``compare_with_catalog`` gives them."""
    own = texts.select(F.concat(F.lit("file:"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("extracted_text").alias("text"))
    return own.unionByName(store.select(F.concat(F.lit("stored:"), "document_id").alias("doc_id"), F.col("extracted_text").alias("text")))
