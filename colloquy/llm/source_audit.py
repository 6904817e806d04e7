"""How far the sources of a language diverge from each other, and in which terms.

Every (lang, source) group, and every language as a whole, is a vector of counts over the ids of its language's kept
terms, held as a binary segment tree per segment of ids. Nodes are hash-consed: equal count subtrees, of whatever group
or place, are one node. Two trees are traversed together; a pair of nodes is priced once however often it recurs,
so shared runs (all the terms that both sources lack, for one) cost one visit. Prices add up from the leaves. The
same traversal of a group's tree with its language's tree carries maxima instead, and the top terms are found by
descending into the best pairs.

Terms are counted per task before they are shuffled. The trees of a segment are dealt to tasks by pairs of blocks of
sources, so a task holds at most two blocks of ``SEGMENT`` counts each; prices of segments are summed by Spark. Memory
is bounded by the blocks, whatever the number of terms or sources; the rows returned are quadratic in the sources of a
language, as pairs are what is asked for.

Null text, lang and source count as empty; an empty table gives no rows; repeated rows and identifiers count as often
as they occur; columns other than the three are never read, so names cannot clash; a text of any length is cut into
terms piece by piece. Ties of value are ranked by the item's UTF-8 bytes. A language without kept terms has divergence 0
between all its sources and no terms.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from colloquy.operators.ordered import dense_position
from colloquy.operators.staging import stage

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
SEGMENT = 1 << 13
BLOCK = 64
PIECE = 1 << 20
HELD_TERMS = 400_000
# Bytes of terms: letters A-Z and a-z and everything outside ASCII; A-Z become small, all others part terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> Counter:
    """Terms of a whole text with their numbers of occurrences."""
    folded = (text or "").encode().translate(_FOLD)
    if len(folded) <= PIECE:
        return Counter(folded.split())
    found, at = Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents per (lang, source, term); the empty term stands for the group itself."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}

    def flush():
        for (lang, source), found in held.items():
            n, docs = np.array(list(found.values()), np.int64).T
            yield pd.DataFrame({"lang": lang, "source": source, "term": [t.decode() for t in found], "n": n, "docs": docs})
        held.clear()

    size = 0
    for pdf in batches:
        for text, lang, source in zip(pdf["text"], pdf["lang"], pdf["source"]):
            group = held.setdefault((lang or "", source or ""), {b"": [0, 0]})
            before = len(group)
            for term, n in terms(text).items():
                seen = group.get(term)
                if seen is None:
                    group[term] = [n, 1]
                else:
                    seen[0] += n
                    seen[1] += 1
            size += len(group) - before
            if size > HELD_TERMS:
                yield from flush()
                size = 0
    yield from flush()


def share(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exact for counts of any size."""
    top = counts + 2
    if len(top) and int(top.max()) >= (1 << 63) // SCALE:
        return np.array([1 + SCALE * int(t) // total for t in top.tolist()], np.int64)
    return 1 + SCALE * top // total


class CountForest:
    """Segment trees of equal height over rows of counts; equal subtrees are one node.

    ``children[h]`` holds the two children of every node of height h + 1; nodes of height 0 are ``values``.
    """

    def __init__(self, counts: np.ndarray):
        ids, self.values = pd.factorize(counts.ravel())
        ids, self.children = ids.reshape(counts.shape), []
        nodes = len(self.values)
        while ids.shape[1] > 1:
            ids_above, keys = pd.factorize((ids[:, ::2] * nodes + ids[:, 1::2]).ravel())
            self.children.append((keys // nodes, keys % nodes))
            ids, nodes = ids_above.reshape(len(ids), -1), len(keys)
        self.roots = ids[:, 0]

    def traverse(self, left: int, right: np.ndarray, leaf: Callable, join: Callable) -> tuple[list, list]:
        """Walk tree ``left`` together with each tree of ``right``.

        Returns per level, from the roots down, the value of every distinct pair of nodes met there, and the places of
        each pair's two child pairs in the level below. ``leaf(which, a, b)`` prices pairs of counts.
        """
        which, x, y = np.arange(len(right)), np.repeat(self.roots[left], len(right)), self.roots[right]
        down = []
        for h in range(len(self.children) - 1, -1, -1):
            low, high = self.children[h]
            nodes = len(self.children[h - 1][0]) if h else len(self.values)
            keys = (np.tile(which, 2) * nodes + np.concatenate([low[x], high[x]])) * nodes + np.concatenate([low[y], high[y]])
            at, keys = pd.factorize(keys)
            down.append((at[:len(x)], at[len(x):]))
            which, x, y = keys // (nodes * nodes), keys // nodes % nodes, keys % nodes
        worth = [leaf(which, self.values[x], self.values[y])]
        for first, second in reversed(down):
            worth.append(join(worth[-1][first], worth[-1][second]))
        return worth[::-1], down


def best_leaves(worth: list, down: list, root: int, k: int) -> list[tuple[int, int]]:
    """(position, value) of the ``k`` largest leaves at or above 0 under a pair of roots, smaller positions first among equals."""
    found, heap = [], [(-int(worth[0][root]), 0, 0, root)]
    while heap and len(found) < k:
        value, start, level, at = heapq.heappop(heap)
        if value > 0:  # the best below is -1
            break
        if level == len(down):
            found.append((start, -value))
            continue
        half = 1 << (len(down) - level - 1)
        for side in (0, 1):
            child = int(down[level][side][at])
            heapq.heappush(heap, (-int(worth[level + 1][child]), start + side * half, level + 1, child))
    return found


def _price(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Prices of one segment for the pairs of two blocks, and the top terms of a block's sources."""
    lang, _, one, two = key
    rows = rows.sort_values(["whole", "block", "source"], na_position="last").reset_index(drop=True)
    size, base = int(rows["size"].iloc[0]), int(rows["base"].iloc[0])
    counts = np.zeros((len(rows), 1 << max(0, size - 1).bit_length()), np.int64)
    counts[:, size:] = -1  # no term
    for i, (pos, n) in enumerate(zip(rows["pos"], rows["n"])):
        if pos is not None and len(pos):
            counts[i, pos] = n
    forest, totals = CountForest(counts), rows["total"].tolist()

    def shares(which, trees, a, b, left):
        p, q, real = np.ones(len(a), np.int64), np.ones(len(a), np.int64), a >= 0
        p[real] = share(a[real], totals[left])
        for k, tree in enumerate(trees):
            mine = real & (which == k)
            q[mine] = share(b[mine], totals[tree])
        return p, q, real

    out, sources = [], rows["source"].tolist()
    blocks, whole = rows["block"].to_numpy(), rows["whole"].to_numpy()
    for left in np.nonzero(~whole & (blocks == one))[0]:
        right = np.nonzero(~whole & (blocks == two) & ((np.arange(len(rows)) > left) | (one != two)))[0]
        if len(right):
            def price(which, a, b):
                p, q, real = shares(which, right, a, b, left)  # noqa: B023
                return np.where(real, (p - q) * (p - q) // (p + q), 0)

            worth, _ = forest.traverse(left, right, price, np.add)
            out += [("pair", sources[left], sources[r], None, int(v)) for r, v in zip(right, worth[0])]
        for tree in np.nonzero(whole)[0]:
            def excess(which, a, b):
                p, q, real = shares(which, [tree], a, b, left)  # noqa: B023
                return np.where(real & (a > 0) & (p > q), (p - q) * (p - q) // (p + q), -1)

            worth, down = forest.traverse(left, np.array([tree]), excess, np.maximum)
            out += [("term", sources[left], None, base + at, v) for at, v in best_leaves(worth, down, 0, TOP_TERMS)]
    found = pd.DataFrame(out, columns=["part", "source", "item", "id", "value"])
    found["id"] = found["id"].astype("Int64")
    return found.assign(lang=lang)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source): pairs of sources and over-used terms.

    ``segment`` is the number of term ids per tree, ``block`` the number of sources per block; neither changes a result.
    """
    read = docs.select(*[F.col(c).cast("string") for c in ("text", "lang", "source")])
    partial = read.mapInPandas(_count, "lang string, source string, term string, n long, docs long")
    counts = stage(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    used = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    # ids follow the terms' bytes, so ties of value go to the smaller id
    vocabulary = stage(dense_position(stage(used.drop("docs"), "kept"), ["lang"], ["term"], F.substring("term", 1, 3), out="id"), "vocabulary")
    place = lambda df: df.withColumn("seg", F.floor(F.col("id") / segment)).withColumn("pos", (F.col("id") % segment).cast("int"))
    kept = stage(place(counts.filter("term <> ''").drop("docs").join(vocabulary.select("lang", "term", "id"), ["lang", "term"]).drop("term")), "group-terms")

    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("all"))
    groups = counts.filter("term = ''").select("lang", "source")
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("sum")), ["lang", "source"], "left")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).join(langs, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    total = lambda n: (F.coalesce(n, F.lit(0)) + 2 * F.col("v")).alias("total")
    trees = groups.join(sizes, "lang").select(
        "lang", "source", F.lit(False).alias("whole"), F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), total(F.col("sum")), "v", "blocks"
    )
    wholes = sizes.select(
        "lang", F.lit(None).cast("string").alias("source"), F.lit(True).alias("whole"), F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"),
        total(F.col("all")), "v", "blocks",
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("v") / segment) - 1)
    grid = trees.unionByName(wholes).withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    grid = grid.withColumn("base", F.col("seg") * segment).withColumn("size", F.least(F.lit(segment), F.col("v") - F.col("base")))
    listed = F.collect_list(F.struct("pos", "n")).alias("held")
    held = kept.groupBy("lang", "source", "seg").agg(listed).unionByName(place(vocabulary).groupBy("lang", "seg").agg(listed).withColumn("source", F.lit(None).cast("string")))
    both = grid.alias("g").join(held.alias("h"), F.expr("g.lang = h.lang AND g.seg = h.seg AND g.source <=> h.source"), "left")
    placed = both.select("g.*", F.transform("held", lambda x: x["pos"]).alias("pos"), F.transform("held", lambda x: x["n"]).alias("n"))
    other = F.when(F.col("whole"), F.array("block")).otherwise(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    dealt = placed.withColumn("other", F.explode(other)).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    priced = stage(
        dealt.select("lang", "seg", "one", "two", "block", "source", "whole", "total", "base", "size", "pos", "n")
        .groupBy("lang", "seg", "one", "two").applyInPandas(_price, "part string, source string, item string, id long, value long, lang string"),
        "prices",
    )
    pairs = priced.filter("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    top = priced.filter("part = 'term'").drop("item").join(vocabulary.select("lang", "id", F.col("term").alias("item")), ["lang", "id"]).drop("id")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = pairs.select("*", rank).unionByName(top.select("*", rank).filter(F.col("rank") <= TOP_TERMS))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def report(docs: DataFrame) -> DataFrame:
    return audit(docs.select("text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 tok AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 per AS (SELECT r, lang, source, term, count(*) AS n FROM tok GROUP BY ALL),
 voc AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM per GROUP BY ALL HAVING count(*) >= 10),
 grp AS (SELECT DISTINCT lang, source FROM d),
 cnt AS (SELECT lang, source, term, sum(per.n)::HUGEINT AS n FROM per JOIN voc USING (lang, term) GROUP BY ALL),
 tot AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM grp LEFT JOIN (SELECT lang, source, n FROM cnt) c USING (lang, source) GROUP BY ALL),
 lng AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM voc GROUP BY ALL),
 p AS (SELECT g.lang, g.source, voc.term, coalesce(cnt.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 2)) // (g.total + 2 * lng.v) AS p,
              1 + (1000000000::HUGEINT * (voc.n + 2)) // (lng.total + 2 * lng.v) AS q
       FROM tot g JOIN voc USING (lang) JOIN lng USING (lang) LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = voc.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
       FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 tops AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM tops))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
