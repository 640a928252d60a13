"""Cost-balanced packing of tokenised documents into training sequences.

A document is its token ids and an end id. It is cut where it must be, a piece of n tokens costs
linear * n + quadratic * n * n, and pieces go, dearest first, to the cheapest sequence that still has
room. Documents are packed block by block of a scan task, which needs no shuffle: a block closes
after so many tokens, opens as few sequences as can hold it, and so wastes less than one sequence.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covote.llm.common import byte_letters

CAPACITY = 1024
END = 0
BLOCK = 1_000_000  # tokens that are packed together
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY



def encoder(vocabulary: str, pattern: str):
    """An encoder of the byte-level BPE in a tokenizer's JSON file, whose ids are in order of the merges.

    The merges run in ``tiktoken``, which takes a third of the time of ``tokenizers`` for the same ids. An added
    token of the file has its own id wherever its string stands in a text, as in ``tokenizers``. Ones that take
    blanks or word ends into account are not supported.
    """
    import json

    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        described = json.load(f)
    added = described.get("added_tokens", [])
    if any(t[rule] for t in added for rule in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens with rules of their own are not supported")
    special = {t["content"]: t["id"] for t in added}
    as_byte = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(as_byte[c] for c in piece): k for piece, k in described["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of ``lengths`` tokens.

    What a document has beyond whole sequences is its last piece. Pieces are dealt in descending
    order to the sequence of least cost that has room; a piece that fits nowhere is cut to the
    largest room left, and its rest is dealt again. The sequences number the least possible.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, rests = 0, []
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((n % capacity, d, n - n % capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    count = -(-sum(r[0] for r in rests) // capacity)
    used = [0] * count
    cheapest = [(0.0, k) for k in range(count)]  # a heap
    todo = [(-n, d, start) for n, d, start in rests]  # a heap, as cut pieces come back
    heapq.heapify(todo)
    while todo:
        n, d, start = heapq.heappop(todo)
        n, passed, found = -n, [], None
        while cheapest:
            cost, k = heapq.heappop(cheapest)
            if used[k] + n <= capacity:
                found = (cost, k)
                break
            passed.append((cost, k))
        if found is None:  # cut it for the emptiest sequence
            found = min(passed, key=lambda x: (used[x[1]], x[1]))
            passed.remove(found)
            room = capacity - used[found[1]]
            heapq.heappush(todo, (room - n, d, start + room))
            n = room
        cost, k = found
        pieces.append((d, start, n, sequence + k, used[k]))
        used[k] += n
        if used[k] < capacity:
            heapq.heappush(cheapest, (cost + LINEAR * n + QUADRATIC * n * n, k))
        for x in passed:
            heapq.heappush(cheapest, x)
    return pieces


def packed(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row per piece.

    ``vocabulary`` is the JSON file of a tokenizer that every executor has, ``pattern`` splits text for it. A null or empty text is the end
    id alone; rows without a doc_id or of a repeated one are packed like others; a long text spans
    many sequences. An empty table has no pieces. ``sequence_id`` counts from the task's number times
    2^33, which a repeated task gives again. Other columns are not read.
    """

    def packing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoder(vocabulary, pattern)
        base = TaskContext.get().partitionId() << 33

        def closed(ids: list, tokens: list[bytes], base: int) -> tuple[pd.DataFrame, int]:
            found = pack(np.array([len(t) // 4 for t in tokens]), capacity)
            crc = [zlib.crc32(memoryview(tokens[d])[4 * start : 4 * (start + n)]) for d, start, n, _, _ in found]
            doc, start, n, sequence, offset = np.array(found, np.int64).T
            out = pd.DataFrame(
                {
                    "doc_id": pd.array([ids[d] for d in doc], "Int64"), "start": start, "length": n, "ids_crc32": crc,
                    "doc_tokens": [len(tokens[d]) // 4 for d in doc], "sequence_id": base + sequence, "offset": offset,
                }
            )
            return out, base + int(sequence.max()) + 1

        ids, tokens, held = [], [], 0
        for rows in batches:
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                tokens.append(np.array([*encoding.encode(text or "", allowed_special="all"), END], "<u4").tobytes())
                held += len(tokens[-1]) // 4
                if held >= block:
                    out, base = closed(ids, tokens, base)
                    yield out
                    ids, tokens, held = [], [], 0
        if tokens:
            yield closed(ids, tokens, base)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        packing,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
