"""Problem 6: documents assigned to containers of fixed capacity.

Lengths are counted in tokens of a public tokenizer. A document longer than the capacity is cut into full containers and a
rest; none else is cut. Packing needs only the number of items of each length, at most ``capacity`` numbers however large
the corpus: minimum bin slack takes the longest length left, finds by subset-sum dynamic programming over bitsets the
multiset of the other lengths that comes closest to the room left, backtracks its counts and repeats that filling as often
as the numbers allow. The fillings, a table bounded by the capacity, are then dealt to the items by their rank within their
length; ranks come from per-partition counts and a prefix sum over partitions, so no length is gathered in one task.

Null and empty texts are items of length 0 and ride in the first container. Repeated ids are items of their own.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.runtime import checkpoint, strings

CAPACITY = 1024
#: More items of one length than any corpus has.
RANKS = 1 << 44
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("attestra", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    return len(encoding(path).encode_ordinary(text))


def fillings(numbers: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: count})``: fillings that use up exactly the given number of items of each length 1..capacity."""
    left = Counter({k: n for k, n in numbers.items() if n > 0 and k > 0})
    out: list[tuple[int, dict[int, int]]] = []
    while left:
        first = max(left)
        room = capacity - first
        take = Counter({first: 1})
        left[first] -= 1
        if room:
            mask, reach = (1 << room + 1) - 1, 1
            steps: list[tuple[int, int, int]] = []  # length, how many at once, what was within reach before
            for size in sorted((k for k in left if k <= room and left[k]), reverse=True):
                n, k = min(left[size], room // size), 1
                while n > 0:
                    k = min(k, n)
                    steps.append((size, k, reach))
                    reach |= reach << size * k & mask
                    n -= k
                    k *= 2
                if reach >> room & 1:
                    break
            at = reach.bit_length() - 1
            for size, k, before in reversed(steps):
                if not before >> at & 1:
                    take[size] += k
                    at -= size * k
        left[first] += 1
        times = min(left[k] // n for k, n in take.items())
        for k, n in take.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append((times, dict(take)))
    return out


def deal(numbers: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of ranks within a length and the container of each: ``start`` (length and first rank in one number, ascending),
    ``each`` (how many of that length a container takes) and ``base`` (the first container). Items of length 0 go to the first.

    There are a few times ``capacity`` ranges, whatever the corpus: the one thing that is broadcast.
    """
    rows, container, used = [], 0, Counter()
    for times, take in fillings(numbers, capacity):
        for size, n in take.items():
            rows.append((size * RANKS + used[size], n, container))
            used[size] += times * n
        container += times
    if numbers.get(0):
        rows.append((0, numbers[0], 0))
    start, each, base = (np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 3
    return start, each, base


def items(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, part, token_start, n_tokens, pid, local``: the items of each document with their rank among the items of
    their length in the same partition."""
    field = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc = encoding(tokenizer)
        for b in batches:
            row, part, start, size, local = [], [], [], [], []
            for i, t in enumerate(strings(b.column(1))):
                n, k = len(enc.encode_ordinary(t)), 0
                while True:
                    s = min(capacity, n - k * capacity)
                    row.append(i), part.append(k), start.append(k * capacity), size.append(s), local.append(int(seen[s]))
                    seen[s] += 1
                    k += 1
                    if k * capacity >= n:
                        break
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int32())), pa.array(part, pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array([pid] * len(row), pa.int32()), pa.array(local, pa.int64())],
                ["id", "part", "token_start", "n_tokens", "pid", "local"],
            )

    kind = field.schema["id"].dataType.simpleString()
    return field.mapInArrow(run, f"id {kind}, part int, token_start int, n_tokens int, pid int, local bigint").withColumnRenamed("id", doc_id)


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``container_id, doc_id, part, token_start, n_tokens``: every document's items, each in one container."""
    spark = documents.sparkSession
    # Texts are tokenised once; the narrow result is written to the checkpoint folder and read twice.
    found = checkpoint(items(documents, capacity, tokenizer, doc_id, text))
    by_partition = found.groupBy("n_tokens", "pid").agg(F.count("*").alias("n"))
    numbers = {r.n_tokens: r.n for r in by_partition.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    dealt = deal(numbers, capacity)
    before = Window.partitionBy("n_tokens").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = by_partition.select("n_tokens", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = found.join(offset, ["n_tokens", "pid"]).select(F.col(doc_id).alias("id"), "part", "token_start", "n_tokens", (F.col("offset") + F.col("local")).alias("rank"))
    shared = spark.sparkContext.broadcast(dealt)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, each, base = shared.value
        for b in batches:
            at = b.column(3).to_numpy().astype(np.int64) * RANKS + b.column(4).to_numpy()
            row = np.searchsorted(start, at, "right") - 1
            container = base[row] + (at - start[row]) // each[row]
            yield pa.RecordBatch.from_arrays([pa.array(container), *b.columns[:4]], ["container_id", "id", "part", "token_start", "n_tokens"])

    kind = ranked.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"container_id bigint, id {kind}, part int, token_start int, n_tokens int").withColumnRenamed("id", doc_id)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, room left unused and the share filled."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    return each.agg(
        F.count("*").alias("containers"),
        F.sum("k").alias("items"),
        F.sum("n").alias("tokens"),
        F.sum(F.lit(capacity) - F.col("n")).alias("unused"),
        F.max("n").alias("fullest"),
        (F.sum("n") / (F.count("*") * F.lit(capacity))).alias("share"),
    )
