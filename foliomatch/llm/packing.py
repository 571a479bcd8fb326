"""Packing documents into sequences of bounded length by multiway differencing (Karmarkar and Karp).

A document is its token ids and an end id. What fills whole sequences is cut off first. The rest of each
document, and the tail of a long one, is a piece; a block of pieces is partitioned into k windows:
every piece begins as a partial partition of its own, and the two partial partitions with the largest
difference between windows are merged again and again, the fullest windows of one with the emptiest of
the other, so that imbalances cancel out. k begins at the least number that can hold the block and rises
whenever a window exceeds the capacity. As pieces may be cut freely, those over ``piece`` tokens are
cut to that size first, which lets the windows come out nearly equal and nearly full.

Scale: each task packs the rows it reads, block by block, so there is no shuffle, memory is bounded by
a block, and a lost task is done again alone. Numbers of sequences hold the number of the task.

Defined cases: null text counts as empty; an empty document is its end id; repeated rows are packed each;
an empty table gives no rows; columns beyond doc_id and text are ignored. No text is shortened.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliomatch.llm.common import table, text_slices
from foliomatch.llm.wordids import encoder

CAPACITY = 4096
PIECE = 512
END_ID = 2
#: Tokens of pieces that are partitioned at once, and bytes of text that are tokenised at once.
BLOCK_TOKENS = 1 << 20
BATCH_BYTES = 1 << 22
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Partition the sizes into k windows with nearly equal sums; returns the places of the sizes in each.

    A partial partition keeps its non-empty windows only, fullest first; merging pairs its fullest
    windows with the other's emptiest (empty ones before all)."""
    heap = [(-n, i, [(n, (i,))]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the last `over` windows of a meet those of b in the opposite order
            x, y = a[-over:], b[-over:][::-1]
            merged = a[:-over] + b[:-over] + [(p[0] + q[0], (p[1], q[1])) for p, q in zip(x, y, strict=True)]
        merged.sort(key=itemgetter(0), reverse=True)
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], made, merged))
        made += 1
    windows = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            for part in node:
                if isinstance(part, tuple):
                    stack.append(part)
                else:
                    items.append(part)
        windows.append(sorted(items))
    return windows


def windows_for(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few windows as differencing can fit: the number rises while one exceeds the capacity."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        most = max(sum(sizes[i] for i in w) for w in found)
        if most <= capacity:
            return found
        k += max(1, int(k * (most - capacity) / (4 * capacity)))


def pieces_of(tokens: int, capacity: int = CAPACITY, piece: int = PIECE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's full sequences, and of the pieces of what is left, nearly equal ones."""
    full = tokens // capacity
    left = tokens - full * capacity
    n = -(-left // piece)
    at = [full * capacity + left * i // n for i in range(n)] + [tokens] if n else []
    return [(i * capacity, capacity) for i in range(full)], [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document (SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        made, rows, block, held = 0, [], [], 0

        def close() -> None:
            """Partition the block's pieces into windows."""
            nonlocal made, block, held
            for window in windows_for([p[2] for p in block], capacity):
                at = 0
                for i in window:
                    doc, start, length, crc, tokens = block[i]
                    rows.append((doc, start, length, crc, tokens, base + made, at))
                    at += length
                made += 1
            block, held = [], 0

        def out() -> pa.RecordBatch:
            nonlocal rows
            done, rows = rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*done, strict=True) if done else [[]] * 7)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        code = encoder(tokenizer)
        for docs_, texts in text_slices(batches, BATCH_BYTES):
            ids, starts = code.encode(texts)
            for k, doc in enumerate(docs_.to_pylist()):
                own = np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id)).astype("<u4")
                full, rest = pieces_of(len(own), capacity, piece)
                crc = lambda a, n, own=own: zlib.crc32(own[a : a + n].tobytes())
                for a, n in full:
                    rows.append((doc, a, n, crc(a, n), len(own), base + made, 0))
                    made += 1
                for a, n in rest:
                    block.append((doc, a, n, crc(a, n), len(own)))
                    held += n
                if held >= BLOCK_TOKENS:
                    close()
                if len(rows) >= 20_000:
                    yield out()
        close()
        yield out()
        code.clear()  # an idle worker holds no memory

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())
