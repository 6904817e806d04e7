"""Remove byte strings that repeat anywhere, decided by suffix arrays over the places where texts can be equal.

A window is the ``length`` bytes from one position on. Equal windows are brought together first:

* Anchors are positions whose k-byte hash is the least of some run of neighbouring ones, so equal windows hold equal
  anchors in equal places. A window belongs to the first anchor that lies at least ``reach`` bytes after its start.
* The windows of one anchor form a unit. They all contain the unit's core, whose hash is the unit's key; a key that
  occurs once cannot repeat and is done. That leaves a small part of the text.
* Equal units (same key, same bytes) are counted, not compared: all their windows repeat.
* The different units of a key differ only before and after the core. They are joined with the core as one symbol
  and sorted by the grouping suffix array; a window repeats if its suffix shares a whole window with a neighbour.

A key with very many different units is not sorted in one task: its windows are counted one by one by their hashes.
Texts are told apart by their SHA-256, so copies are read once. All tables between steps hold hashes and places; whole
texts are moved once, to single out those that hold a repeat. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.suffix_array import neighbour_lengths, suffix_array
from colloquy.operators.staging import stage

LENGTH = 400
GRAM = 32
SEGMENT = 1 << 20
UNITS_IN_TASK = 1000


def reach_of(length: int) -> int:
    """Longest distance for which a window shows all that chooses its anchor: 3 reach + GRAM <= length + 2."""
    reach = (length + 2 - GRAM) // 3
    if reach < 2:
        raise ValueError("length is too short for its anchors")
    return reach


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` elements."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def anchors(b: bytes, reach: int) -> np.ndarray:
    """Positions whose gram hash is the least of a run of ``reach`` grams that holds it; all of equal ones count."""
    n = len(b) - GRAM + 1
    found = []
    for at in range(0, n - reach + 1, SEGMENT):
        low, high = max(0, at - reach), min(n, at + SEGMENT + reach)  # a gram's choice depends on reach - 1 to each side
        h = np.frombuffer(b, np.uint8, high - low + GRAM - 1, low).astype(np.uint32) + np.uint32(1)
        width, factor = 1, 0x9E3779B1
        while width < GRAM:
            h = h[:-width] * np.uint32(factor) + h[width:]
            factor = factor * factor & 0xFFFFFFFF
            width *= 2
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        least = _slide(h, reach, np.minimum)
        pad = np.zeros(reach - 1, np.uint32)
        chosen = _slide(np.concatenate([pad, least, pad]), reach, np.maximum) == h
        p = np.nonzero(chosen)[0] + low
        found.append(p[(p >= at) & (p < at + SEGMENT)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def units(b: bytes, length: int) -> np.ndarray:
    """Rows (first window, last window, core start) of the units of one text, in order."""
    if len(b) < length:
        return np.zeros((0, 3), np.int64)
    reach = reach_of(length)
    p = anchors(b, reach)
    last = np.minimum(p - reach, len(b) - length)
    first = np.maximum(0, np.concatenate([[-1], p[:-1] - reach]) + 1)
    keep = first <= last
    return np.stack([first, last, p - reach], axis=1)[keep]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _hashed_units(docs: DataFrame, length: int) -> DataFrame:
    """Per row with units: rid, tid and the arrays key and body (hash of all that the unit covers)."""
    core_size = length - reach_of(length) + 1

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core_of, body_of = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for rows in batches:
            out = []
            for rid, tid, text in zip(rows["rid"], rows["tid"], rows["text"]):
                b = text.encode()
                keys, bodies = [], []
                for first, last, core in units(b, length).tolist():
                    keys.append(core_of(b[core:core + core_size]))
                    bodies.append(body_of(b[first:last + length], core - first))
                if keys:
                    out.append((rid, tid, np.array(keys, np.uint64).view(np.int64), np.array(bodies, np.uint64).view(np.int64)))
            yield pd.DataFrame(out, columns=["rid", "tid", "key", "body"])

    long_enough = docs.filter(F.octet_length("text") >= length).select(F.monotonically_increasing_id().alias("rid"), "tid", "text")
    return long_enough.mapInPandas(hashes, "rid long, tid string, key array<long>, body array<long>")


def _parts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes before, in and after the core of each wanted (key, body, n, idx) of a text."""
    core_size = length - reach_of(length) + 1

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for tid, text, asked in zip(rows["tid"], rows["text"], rows["asked"]):
                b = text.encode()
                spans = units(b, length)
                for w in asked:
                    first, last, core = spans[w["idx"]].tolist()
                    after = core + core_size
                    out.append((w["key"], w["body"], w["n"], tid, w["idx"], b[first:core], b[core:after], b[after:last + length], core - last))
            yield pd.DataFrame(out, columns=["key", "body", "n", "tid", "idx", "head", "core", "tail", "near"])

    asked = wanted.groupBy("tid").agg(F.collect_list(F.struct("key", "body", "n", "idx")).alias("asked"))
    schema = "key long, body long, n long, tid string, idx int, head binary, core binary, tail binary, near int"
    return texts.join(asked, "tid").select("tid", "text", "asked").mapInPandas(cut, schema)


def repeated_windows(heads: list[bytes], tails: list[bytes], nears: list[int], reach: int) -> list[list[int]]:
    """Of units with one core: per unit the distances before the core at which a window starts that another unit holds.

    A window that starts t bytes before the core is t symbols, the core, and reach - 1 - t symbols after it.
    """
    symbols: list[int] = []
    owner: list[tuple[int, int]] = []
    m = len(heads)
    for u, (head, tail) in enumerate(zip(heads, tails)):
        owner += [(u, t) for t in range(len(head), -1, -1)] + [(u, -1)] * (len(tail) + 1)
        symbols += [m + 1 + c for c in head]
        symbols.append(m + 257)
        symbols += [m + 1 + c for c in tail]
        symbols.append(u)  # ends differ, so nothing is shared across them
    order = suffix_array(symbols)
    shared = neighbour_lengths(symbols, order)
    shared.append(0)
    found: list[list[int]] = [[] for _ in heads]
    for p, i in enumerate(order):
        u, t = owner[i]
        if t >= nears[u] and (shared[p] >= reach or shared[p + 1] >= reach):
            found[u].append(t)
    return found


def _sorted_repeats(parts: DataFrame, length: int) -> DataFrame:
    """(tid, idx, t): windows of single units that another unit of their key holds, by suffix arrays."""
    reach = reach_of(length)

    def settle(rows: list) -> list[tuple[str, int, int]]:
        by_core: dict[bytes, dict] = {}
        for r in rows:
            by_core.setdefault(r.core, {})[r.head, r.tail, r.near] = r
        out = []
        for same in by_core.values():
            us = list(same.values())
            if len(us) > 1:
                found = repeated_windows([u.head for u in us], [u.tail for u in us], [u.near for u in us], reach)
                out += [(u.tid, u.idx, t) for u, ts in zip(us, found) if u.n == 1 for t in ts]
        return out

    def repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list = []
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if group and group[0].key != r.key:
                    out += settle(group)
                    group = []
                group.append(r)
            yield pd.DataFrame(out, columns=["tid", "idx", "t"])
        if group:
            yield pd.DataFrame(settle(group), columns=["tid", "idx", "t"])

    return parts.repartition("key").sortWithinPartitions("key").mapInPandas(repeats, "tid string, idx int, t int")


def _counted_repeats(parts: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many units: every window is counted by two hashes."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                b = r.head + r.core + r.tail
                for t in range(r.near, len(r.head) + 1):
                    w = b[len(r.head) - t:len(r.head) - t + length]
                    out.append((_signed(xxhash.xxh3_64_intdigest(w)), _signed(xxhash.xxh64_intdigest(w)), r.n, r.tid, r.idx, t))
            yield pd.DataFrame(out, columns=["h1", "h2", "n", "tid", "idx", "t"])

    seen = stage(parts.mapInPandas(windows, "h1 long, h2 long, n long, tid string, idx int, t int"), "windows")
    often = seen.groupBy("h1", "h2").agg(F.sum("n").alias("all")).filter("all > 1").select("h1", "h2")
    return seen.filter("n = 1").join(often, ["h1", "h2"], "left_semi").select("tid", "idx", "t")


def _removed(texts: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Per text with repeats: removed bytes and runs, digest of the rest; ``whole`` units and single windows are given."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for tid, text, whole, some in zip(rows["tid"], rows["text"], rows["whole"], rows["some"]):
                b = text.encode()
                at = units(b, length)
                change = np.zeros(len(b) + 1, np.int32)
                for first, last, _ in at[np.array(list(whole), dtype=np.int64)].tolist():
                    change[first] += 1
                    change[last + length] -= 1
                for s in some:
                    start = int(at[s["idx"], 2]) - s["t"]
                    change[start] += 1
                    change[start + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
                out.append((tid, int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(out, columns=["tid", "n_removed", "n_spans", "kept_sha256"])

    return texts.join(spans, "tid").select("tid", "text", "whole", "some").mapInPandas(remove, "tid string, n_removed long, n_spans long, kept_sha256 string")


def repeated_text(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(tid, n_removed, n_spans, kept_sha256) of every distinct text that loses bytes; ``tid`` is its SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.sha2(text, 256).alias("tid"), text.alias("text"))
    hashed = stage(_hashed_units(own, length), "units")
    row = hashed.select("rid", F.posexplode(F.arrays_zip("key", "body")).alias("idx", "u")).select("rid", "idx", "u.key", "u.body")
    shared = stage(row.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
    met = stage(row.join(shared, "key", "left_semi"), "met")
    bodies = stage(met.groupBy("key", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "idx")).alias("one")), "bodies")
    ids = hashed.select("rid", "tid")
    whole = met.join(bodies.filter("n > 1"), ["key", "body"], "left_semi").join(ids, "rid").groupBy("tid").agg(F.collect_set("idx").alias("whole"))
    whole = stage(whole, "whole")
    several = bodies.groupBy("key").agg(F.count(F.lit(1)).alias("bodies"), F.min("n").alias("least")).filter("bodies > 1 AND least = 1")
    asked = bodies.join(several, "key").select("key", "body", "n", "one.*", "bodies").join(ids, "rid").drop("rid")
    asked = stage(asked, "asked")
    wanted = asked.select("tid").unionByName(whole.select("tid")).distinct()
    texts = stage(own.join(wanted, "tid", "left_semi").dropDuplicates(["tid"]), "texts")
    parts = _parts(texts, asked.filter(F.col("bodies") <= UNITS_IN_TASK), length)
    windows = _sorted_repeats(parts, length)
    crowded = asked.filter(F.col("bodies") > UNITS_IN_TASK)
    if not crowded.isEmpty():
        windows = windows.unionByName(_counted_repeats(_parts(texts, crowded, length), length))
    some = windows.groupBy("tid").agg(F.collect_set(F.struct("idx", "t")).alias("some"))
    none = lambda c, of: F.coalesce(F.col(c), F.array().cast(of)).alias(c)
    spans = whole.join(some, "tid", "full_outer").select("tid", none("whole", "array<int>"), none("some", "array<struct<idx:int,t:int>>"))
    return _removed(texts, spans, length)


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("tid"))
    found = rows.join(stage(repeated_text(docs, "text", length), "removed"), "tid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "tid").alias("kept_sha256"))
