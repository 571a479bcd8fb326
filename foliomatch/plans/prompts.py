"""Prompts for a language model as column expressions, and a model passed in by the caller."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomatch.sources.workers import Factory, made

CLASSIFY_CHARS, COMPARE_CHARS, PREVIEW_CHARS = 10_000, 20_000, 3_000
CLASSIFY_TOKENS, COMPARE_TOKENS, SUMMARY_TOKENS = 1_024, 36_000, 5_000
CLASSIFY = {"en": "State what kind of document this is and sum it up briefly:\n\n", "th": "บอกชนิดของเอกสารและสรุปย่อ:\n\n"}
COMPARE = {
    ("en", "diff"): "Compare these two documents. Report what differs: wording, numbers, missing passages.",
    ("en", "same"): "Compare these two documents. Report what agrees: names, numbers, dates, amounts.",
    ("th", "diff"): "เปรียบเทียบเอกสารสองฉบับนี้ รายงานเฉพาะส่วนที่ต่างกัน ตอบเป็นภาษาไทย",
    ("th", "same"): "เปรียบเทียบเอกสารสองฉบับนี้ รายงานเฉพาะส่วนที่ตรงกัน ตอบเป็นภาษาไทย",
}


def _cut(c: str, n: int) -> Column:
    return F.substring(F.col(c), 1, n)


def classify(text: str = "text", language: str = "en") -> Column:
    return F.concat(F.lit(CLASSIFY[language]), _cut(text, CLASSIFY_CHARS))


def compare(text1: str = "text1", text2: str = "text2", language: str = "en", mode: str = "diff") -> Column:
    """Null if either text is null; callers leave blank texts out."""
    return F.concat(F.lit(COMPARE[language, mode] + "\n\n<document_1>\n"), _cut(text1, COMPARE_CHARS), F.lit("\n</document_1>\n\n<document_2>\n"), _cut(text2, COMPARE_CHARS), F.lit("\n</document_2>"))


def summary(text1: str = "text1", text2: str = "text2") -> Column:
    """From a diff summary's columns and both texts."""
    s = lambda c: F.col(c).cast("string")
    stats = F.concat(
        F.lit("Words only in document 1: "), s("diff_doc1"), F.lit("\nWords only in document 2: "), s("diff_doc2"),
        F.lit("\nSample 1: "), F.col("sample_doc1"), F.lit("\nSample 2: "), F.col("sample_doc2"),
    )
    return F.concat(F.lit("Explain this comparison: document type, key data, what agrees, what differs, what to verify.\n\n"), stats, F.lit("\n\nDocument 1:\n"), _cut(text1, PREVIEW_CHARS), F.lit("\n\nDocument 2:\n"), _cut(text2, PREVIEW_CHARS))


EXPLAIN = {
    "en": "Explain the result of this comparison: what kind of documents they are, their key data, what agrees, what differs, what it means and what to verify.",
    "th": "อธิบายผลการเปรียบเทียบนี้เป็นภาษาไทย: ชนิดของเอกสาร ข้อมูลสำคัญ สิ่งที่ตรงกัน สิ่งที่ต่างกัน ความหมาย และสิ่งที่ควรตรวจสอบ",
}


def explain(mode: str = "diff", language: str = "en") -> Column:
    """From a summary of either mode with name1, name2, text1 and text2: names, sizes, the rate to one decimal, samples and the
    beginnings of the texts. A null or empty text is left out."""
    s = lambda c: F.col(c).cast("string")
    doc = lambda n: F.concat(F.lit(f"Document {n}: "), F.coalesce(s(f"name{n}"), F.lit(f"Document {n}")), F.lit(" ("), s(f"doc{n}_pages"), F.lit(" pages, "), s(f"doc{n}_total_words"), F.lit(" words)"))
    rate = lambda what, c: F.format_string(f"{what} rate: %.1f%%", F.col(c).cast("double"))
    if mode == "same":
        own = [F.concat(F.lit(f"Matching words in document {n}: "), s(f"matched_doc{n}")) for n in (1, 2)]
        own += [rate("Match", "match_rate"), F.concat(F.lit("Sample: "), F.col("sample_matched"))]
    else:
        own = [F.concat(F.lit(f"Words only in document {n}: "), s(f"diff_doc{n}")) for n in (1, 2)]
        own += [rate("Difference", "diff_rate"), *[F.concat(F.lit(f"Sample {n}: "), F.col(f"sample_doc{n}")) for n in (1, 2)]]
    stats = F.concat_ws("\n", F.lit("Mode: matches" if mode == "same" else "Mode: differences"), doc(1), doc(2), *own)
    previews = [F.when(F.length(f"text{n}") > 0, F.concat(F.lit(f"Document {n}:\n"), _cut(f"text{n}", PREVIEW_CHARS))) for n in (1, 2)]
    return F.concat_ws("\n\n", F.lit(EXPLAIN[language]), stats, *previews)


class Limits(NamedTuple):
    """Prompts asked at once by a task, tries of each, seconds before the second try, doubled for each further one."""

    at_once: int = 4
    tries: int = 3
    wait: float = 1.0


def _asked(model: Callable[[str, int], str], prompt: str, max_tokens: int, limits: Limits) -> tuple[str, bool]:
    """The answer, or the last error as text, and whether it is an answer."""
    for i in range(limits.tries):
        try:
            return model(prompt, max_tokens), True
        except Exception as e:  # the model is the caller's code: whatever it raises is tried again, then reported
            said = f"Error: {e}"
            if i < limits.tries - 1:
                time.sleep(limits.wait * 2**i)
    return said, False


def answered(prompts: DataFrame, model: Callable[[str, int], str] | Factory, max_tokens: int, limits: Limits = Limits()) -> DataFrame:
    """prompts (key, prompt) with the model's answer; an error, after the last try, becomes the answer's text. A factory makes the
    model's client once a worker. Prompts of a task are asked a few at once, and not again until those are answered."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = made(model) if isinstance(model, Factory) else model
        with ThreadPoolExecutor(limits.at_once) as pool:
            for part in parts:
                yield part.assign(answer=[x for x, _ in pool.map(lambda p: _asked(client, p, max_tokens, limits), part["prompt"])])

    return prompts.select("key", "prompt").mapInPandas(run, "key long, prompt string, answer string")


def answered_once(prompts: DataFrame, model: Callable[[str, int], str] | Factory, max_tokens: int, folder: str, limits: Limits = Limits()) -> DataFrame:
    """``answered`` for prompts that cost: each answer is kept in `folder` as soon as it is there, a small file a prompt by the digest of
    prompt and max_tokens, and a prompt that has one isn't asked. A task that is run again, as after a lost executor, and a job that
    is begun again ask only what isn't answered. Errors aren't kept. Equal prompts are asked once.

    folder is one that driver and executors share, by the Python path of its mount."""
    digest = F.sha2(F.concat_ws(":", F.lit(max_tokens), "prompt"), 256)
    rows = prompts.select("key", "prompt").withColumn("digest", digest)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = made(model) if isinstance(model, Factory) else model

        def ask(prompt: str, name: str) -> str:
            at = os.path.join(folder, name[:2], name)
            if os.path.exists(at):
                with open(at, encoding="utf-8") as f:
                    return f.read()
            said, good = _asked(client, prompt, max_tokens, limits)
            if good:
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{at}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(said)
                os.replace(part, at)
            return said

        with ThreadPoolExecutor(limits.at_once) as pool:
            for part in parts:
                yield pd.DataFrame({"digest": part["digest"], "answer": list(pool.map(ask, part["prompt"], part["digest"]))})

    # a prompt that may be null has no digest of its own: it is left out, and its answer is null
    each = rows.filter(F.col("prompt").isNotNull()).groupBy("digest").agg(F.first("prompt").alias("prompt"))
    return rows.join(each.select("prompt", "digest").mapInPandas(run, "digest string, answer string"), "digest", "left").select("key", "prompt", "answer")
