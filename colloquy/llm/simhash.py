"""Near duplicates by SimHash, linked through a binary trie joined with itself.

Distinct fingerprints are dealt to shards: fingerprints with at most k differing bits agree on one of k+1 blocks of
bits, so each goes to one shard per block. Within a shard the fingerprints form a binary trie below the shared block.
Pairs of its nodes are traversed together, level by level; a pair adds up its differing bits and is dropped once
they exceed the budget. A shard returns a spanning forest of its links, never all pairs of a group; components then
grow by joins. A fingerprint with a third of all documents is one trie leaf, counted once.

Nothing but row counts reaches the driver. A null text counts as empty and has fingerprint zero.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from colloquy.operators.staging import stage

WORDS = 3
BITS = 64
MAX_DIFFER = 3
SEED = 42
PAIRS_AT_ONCE = 1_000_000
HASHES_AT_ONCE = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    found = _WORD.findall((text or "").encode().translate(_LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = ends[words - 1:].tolist() or [len(joined)]
    total, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(last), HASHES_AT_ONCE):
        spans = zip(starts[at:at + HASHES_AT_ONCE].tolist(), last[at:at + HASHES_AT_ONCE])
        h = np.array([digest(joined[i:j], SEED) for i, j in spans], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.nonzero(total * 2 > len(last))[0].tolist()))


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def _join_trie(f: np.ndarray, shard: np.ndarray, top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of one shard whose ``f`` differ in at most ``budget`` bits; rows are sorted by (shard, f).

    Only the low ``top`` bits of ``f`` vary in a shard. A trie node is a range of rows.
    """
    ones = [np.concatenate([[0], np.cumsum((f >> np.uint64(b)) & np.uint64(1))]).astype(np.int64) for b in range(top)]
    cuts = np.nonzero(np.diff(shard))[0] + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(f)]])
    big = hi - lo > 1
    stack = [(top, lo[big], hi[big], lo[big], hi[big], np.zeros(big.sum(), np.int8))]
    while stack:
        level, a, b, c, d, cost = stack.pop()
        if not len(a):
            continue
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            stack += [(level, *(x[s] for x in (a, b, c, d, cost))) for s in (slice(None, half), slice(half, None))]
            continue
        leaf = (b - a == 1) & (d - c == 1)
        if leaf.any():
            i, j = a[leaf], c[leaf]
            near = np.bitwise_count(f[i] ^ f[j]) <= budget
            yield i[near], j[near]
            a, b, c, d, cost = (x[~leaf] for x in (a, b, c, d, cost))
            if not len(a):
                continue
        bit = ones[level - 1]
        split = lambda lo, hi: hi - (bit[hi] - bit[lo])  # noqa: B023,E731
        m, n, same = split(a, b), split(c, d), a == c
        parts = [(a, m, c, n, cost, None), (m, b, n, d, cost, None), (a, m, n, d, cost + 1, None), (m, b, c, n, cost + 1, ~same)]
        kept = []
        for p, q, r, s, e, only in parts:
            ok = (q > p) & (s > r) & (e <= budget)
            ok &= ~((p == r) & (q - p == 1))  # a leaf with itself
            if only is not None:
                ok &= only
            kept.append([x[ok] for x in (p, q, r, s, e)])
        stack.append((level - 1, *(np.concatenate(x) for x in zip(*kept))))


class _Forest:
    """Union-find over row numbers that returns the links that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        new = []
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                new.append((x, y))
        return new


def near_links(prints: DataFrame, max_differ: int = MAX_DIFFER) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs with at most ``max_differ`` differing bits.

    ``prints`` has one row per distinct ``fp``.
    """
    blocks = max_differ + 1
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    widest = max(hi - lo for lo, hi in zip(bounds, bounds[1:]))
    # Rotated left until the shard's block is on top: the rest of the bits varies below it.
    turned = lambda lo: F.col("fp") if lo == 0 else F.shiftleft("fp", lo).bitwiseOR(F.shiftrightunsigned("fp", BITS - lo))
    rows = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), turned(bounds[k]).alias("turned")) for k in range(blocks)])).alias("s"))
    rows = rows.select("fp", "s.block", "s.turned").withColumn("shard", F.shiftrightunsigned("turned", BITS - (bounds[1] - bounds[0])))
    if widest != bounds[1] - bounds[0]:
        raise ValueError("max_differ + 1 must divide 64")
    top = BITS - widest

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["fp"].to_numpy(), b["turned"].to_numpy(), b["block"].to_numpy()) for b in batches]
        if not parts:
            return
        fp, turned, block = (np.concatenate(x) for x in zip(*parts))
        turned = turned.view(np.uint64)
        order = np.lexsort((turned, block))
        fp, turned, block = fp[order], turned[order], block[order]
        shard = (block.astype(np.uint64) << np.uint64(widest)) | (turned >> np.uint64(top))
        forest = _Forest(len(fp))
        for i, j in _join_trie(turned, shard, top, max_differ):
            new = forest.link(i, j)
            if new:
                at = np.array(new)
                yield pd.DataFrame({"a": fp[at[:, 0]], "b": fp[at[:, 1]]})

    return rows.repartition("block", "shard").select("fp", "turned", "block").mapInPandas(links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node, the component named by its smallest node.

    Each round moves every node to the smallest node it sees: once towards larger, once towards smaller neighbours.
    Rounds grow with the logarithm of the number of nodes; each is written to the shared folder.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = stage(small, "links")
        if new.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(new, ["u", "v"], "left_anti").isEmpty():
            break
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_differ: int = MAX_DIFFER) -> DataFrame:
    """doc_id, fp (the fingerprint as a long) and component_id (smallest doc_id reachable) of every row."""
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), fingerprint_of(F.col(text_col)).alias("fp")), "prints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(near_links(prints.select("fp"), max_differ))
    group = stage(prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("g")), "groups")
    named = group.join(group.groupBy("g").agg(F.min("least").alias("component_id")), "g").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The document with the smallest identifier of every group of near duplicates, columns unchanged.

    Identifiers are expected to be distinct; rows without one stay.
    """
    found = near_duplicates(docs, id_col)
    drop = found.filter("doc_id > component_id").select(F.col("doc_id").alias(id_col))
    return docs.join(drop, id_col, "left_anti").select(*docs.columns)
