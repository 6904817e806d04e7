"""Pack documents into sequences of at most ``capacity`` tokens by linear grouping.

Documents are cut only if they are longer than a sequence; all pieces but the first are then full. What is left to
pack is a histogram of at most ``capacity`` different lengths, so the plan is made on counts alone:

1. Large lengths are ranked and divided into groups of equal cardinality; each is rounded up to its group's largest.
2. With these few sizes, configurations (how many of each size share a sequence) are chosen by dynamic programming:
   the largest size left is completed as full as possible, as often as the counts allow.
3. Actual documents take the slots, longest first in each group, which leaves at least the planned room.
4. Small documents go, longest first, where the least room is left that still holds them.

The plan is a table of runs (equal lengths in consecutive sequences); its size depends on the capacity, not on the
number of documents. Documents find their run by their rank among equal lengths. Ranks come from counts per slice of
rows, so one length may hold a third of all rows.

A null text counts as empty: it is one piece, the end token. Rows are told apart by their place in the staged table,
so repeated rows and identifiers are packed one by one.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from colloquy.operators.staging import stage

CAPACITY = 1024
GROUPS = 512
LARGE = 128
# Characters on which both encoders split alike; other texts go to the slower one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_LONG_GAP = re.compile(r"\s{500}")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoders(path: str):
    import json

    import tiktoken
    from tokenizers import Tokenizer

    from colloquy.llm.token_counts import byte_values

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    ranks = {byte_values(piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return exact, fast


@lru_cache(maxsize=2)
def _added(path: str) -> re.Pattern:
    """What an added token looks like in a text."""
    exact, _ = _encoders(path)
    return re.compile("|".join(sorted(re.escape(t.content) for t in exact.get_added_tokens_decoder().values())) or "(?!)")


def token_ids(text: str | None, path: str) -> list[int]:
    """Ids of the whole text by the vocabulary at ``path``; no special tokens are put around it.

    The second encoder holds the same vocabulary and is faster; it is used for characters on which both agree, but for very long gaps
    and for texts that contain an added token, which the first encoder gives its own id.
    """
    exact, fast = _encoders(path)
    text = text or ""
    if _PLAIN.fullmatch(text) and not _LONG_GAP.search(text) and not _added(path).search(text):
        return fast.encode_ordinary(text)
    return exact.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and the row's place ``rid``."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for rid, doc_id, text in zip(rows["rid"], rows["doc_id"], rows["text"]):
                ids = np.array([*token_ids(text, path), end_id], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    out.append((rid, doc_id, k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            yield pd.DataFrame(out, columns=["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(pieces, "rid long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Run:
    """``count`` consecutive sequences from ``first`` on, filled alike up to ``used``."""

    __slots__ = ("first", "count", "used")

    def __init__(self, first: int, count: int, used: int):
        self.first, self.count, self.used = first, count, used


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in groups of equal cardinality as (length, count); a length may span two groups."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(how many of each size, times used). Sizes are descending; every size is used up.

    The largest size left is taken once and completed by the fullest combination of what is left.
    """
    left, out = list(counts), []
    for k, size in enumerate(sizes):
        while left[k]:
            room = capacity - size
            # best[j][r]: reached with sizes j.. ; walk from small to large so that large ones are preferred on ties.
            reach = np.full(room + 1, -1, np.int64)  # last size index that made this sum
            reach[0] = len(sizes)
            made = np.zeros((len(sizes) + 1, room + 1), np.int16)
            for j in range(k, len(sizes)):
                s, most = sizes[j], left[j] - (j == k)
                if s > room or most <= 0:
                    continue
                for r in range(s, room + 1):
                    if reach[r] < 0 and reach[r - s] >= 0:
                        used = made[j, r - s] if reach[r - s] == j else 0
                        if used < most:
                            reach[r], made[j, r] = j, used + 1
            best = int(np.nonzero(reach >= 0)[0].max())
            shape = [0] * len(sizes)
            shape[k] = 1
            while best:
                j = int(reach[best])
                shape[j] += 1
                best -= sizes[j]
            times = min(left[j] // n for j, n in enumerate(shape) if n)
            for j, n in enumerate(shape):
                left[j] -= n * times
            out.append((shape, times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int = LARGE):
    """Runs of placements (length, rank, count, sequence, offset, per_sequence) and the number of sequences.

    The item of rank ``rank + t`` among those of ``length`` goes to ``sequence + t // per_sequence``.
    """
    placed, runs, next_rank, n_seq = [], [], defaultdict(int), 0

    def put(length: int, n: int, sequence: int, offset: int, each: int) -> None:
        placed.append((length, next_rank[length], n, sequence, offset, each))
        next_rank[length] += n

    if counts.get(capacity):
        put(capacity, counts[capacity], 0, 0, 1)
        n_seq = counts[capacity]
    big = linear_groups({k: n for k, n in counts.items() if large <= k < capacity}, groups)
    sizes = [g[0][0] for g in big]
    merged: dict[int, list[tuple[int, int]]] = {}
    for g in big:
        merged.setdefault(g[0][0], []).extend(g)
    sizes = list(merged)
    supply = {s: [list(x) for x in g] for s, g in merged.items()}
    for shape, times in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity):
        fresh = [Run(n_seq, times, 0)]
        n_seq += times
        for s, slots in zip(sizes, shape):
            for _ in range(slots):
                after = []
                for run in fresh:
                    at = 0
                    while at < run.count:
                        length, n = supply[s][0]
                        take = min(n, run.count - at)
                        put(length, take, run.first + at, run.used, 1)
                        after.append(Run(run.first + at, take, run.used + length))
                        supply[s][0][1] -= take
                        if not supply[s][0][1]:
                            supply[s].pop(0)
                        at += take
                fresh = after
        runs += fresh
    open_runs = sorted(((capacity - r.used, r.first, r.count) for r in runs))
    for length in sorted((k for k in counts if k < large), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(open_runs, (length,))
            if at == len(open_runs):
                each = capacity // length
                room, first, count = capacity, n_seq, -(-left // each)
                n_seq += count
            else:
                room, first, count = open_runs.pop(at)
                each = room // length
            full = min(count, left // each)
            if full:
                put(length, full * each, first, capacity - room, each)
                left -= full * each
                if room > each * length:
                    bisect.insort(open_runs, (room - each * length, first, full))
            rest = count - full
            if rest and left and left < each:
                put(length, left, first + full, capacity - room, left)
                bisect.insort(open_runs, (room - left * length, first + full, 1))
                left, full, rest = 0, full + 1, rest - 1
            if rest:
                bisect.insort(open_runs, (room, first + full, rest))
    return placed, n_seq


def ranked(pieces: DataFrame, slices: int) -> DataFrame:
    """Add ``rank`` among pieces of equal length, in slices by row place so that no length is one task."""
    cut_up = pieces.withColumn("_slice", F.pmod(F.xxhash64("rid"), F.lit(slices)))
    sizes = cut_up.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    along = W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = sizes.select("length", "_slice", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    inside = W.partitionBy("length", "_slice").orderBy("rid", "piece")
    return cut_up.withColumn("_in", F.row_number().over(inside)).join(before, ["length", "_slice"]).withColumn("rank", F.col("_before") + F.col("_in") - 1).drop("_slice", "_in", "_before")


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, rows_per_slice: int = 5_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = stage(tokenized_pieces(docs, path, end_id, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    placed, _ = plan(counts, capacity)
    table = defaultdict(list)
    for length, rank, n, sequence, offset, each in placed:
        table[length].append((rank, sequence, offset, each))
    runs = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(v))) for k, v in table.items()}
    spot = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(spot)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length).tolist():
            at = np.nonzero(length == n)[0]
            first, seq, off, each = runs[n]
            k = np.searchsorted(first, rank[at], side="right") - 1
            t = rank[at] - first[k]
            sequence[at], offset[at] = seq[k] + t // each[k], off[k] + t % each[k] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    numbered = ranked(pieces, max(1, sum(counts.values()) // rows_per_slice))
    return numbered.withColumn("_at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def report(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"), path)
