"""Fixed-size encodings: padding, pairs, one-hot and multi-hot vectors, n-best headers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions.binding import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pad_or_cut(tokens, n: int, pad) -> Column:
    p = F.lit(pad) if not isinstance(pad, Column) else pad
    return F.slice(F.concat(_c(tokens), F.array_repeat(p, n)), 1, n)


def truncate(tokens, n) -> Column:
    return F.slice(_c(tokens), 1, n)


def truncate_words(text, n: int) -> Column:
    """First n single-space separated words of a string."""
    return F.array_join(F.slice(F.split(_c(text), " "), 1, n), " ")


def length_mask(length, n) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(1) * n - 1), lambda i: (i < _c(length)).cast("int"))


def pair_lengths(la, lb, n):
    """Lengths after cutting the longer side first (ties cut the second) until both fit in n-3."""
    m = F.lit(n - 3)
    half_up, half_down = F.ceil(m / 2), F.floor(m / 2)
    fits = la + lb <= m
    keep_a = (
        F.when(fits, la).when(lb <= half_down, m - lb).when(la <= half_up, la).otherwise(half_up)
    )
    keep_b = F.when(fits, lb).otherwise(m - keep_a)
    return keep_a.cast("int"), keep_b.cast("int")


def encode_pair(a, b, n: int, pad="[PAD]") -> Column:
    """``struct<tokens, segments, mask, size>`` of ``[CLS] a [SEP] (b [SEP])`` padded to n; b may be null."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    sep = F.array(F.lit("[SEP]"))

    def cut(p):
        ka, kb = pair_lengths(F.size(p["a"]), F.size(p["b"]), n)
        alone = p["b"].isNull()
        ka = F.when(alone, F.least(F.size(p["a"]), F.lit(n - 2))).otherwise(ka)
        first = F.concat(F.array(F.lit("[CLS]")), F.slice(p["a"], F.lit(1), ka), sep)
        second = F.concat(F.slice(p["b"], F.lit(1), kb), sep)
        return F.struct(F.when(alone, first).otherwise(F.concat(first, second)).alias("tokens"), (ka + 2).alias("head"))

    def encode(c):
        size = F.size(c["tokens"])
        return F.struct(
            pad_or_cut(c["tokens"], n, pad).alias("tokens"),
            F.transform(at, lambda i: ((i >= c["head"]) & (i < size)).cast("int")).alias("segments"),
            F.transform(at, lambda i: (i < size).cast("int")).alias("mask"),
            size.alias("size"),
        )

    return let(let(F.struct(_c(a).alias("a"), _c(b).alias("b")), cut), encode)


def one_hot(value, labels) -> Column:
    return F.transform(F.array(*[F.lit(x) for x in labels]), lambda l: (l == _c(value)).cast("int"))


def multi_hot(items, labels) -> Column:
    """0/1 per vocabulary entry; items outside the vocabulary are skipped."""
    names = F.array(*[F.lit(x) for x in labels])
    return let(_c(items), lambda held: F.transform(names, lambda l: F.array_contains(held, l).cast("int")))


def multi_hot_ids(ids, dim) -> Column:
    """0/1 per id below ``dim`` (a number or a column); 0 gives an empty vector."""
    dim = F.lit(dim).cast("int")
    at = F.when(dim > 0, F.sequence(F.lit(0), F.greatest(dim, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return let(_c(ids), lambda held: F.transform(at, lambda i: F.array_contains(held, i).cast("int")))


def hot_ids(vector) -> Column:
    """Inverse of :func:`multi_hot_ids`: the set positions."""
    return F.filter(F.transform(_c(vector), lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())


def result_bucket(n) -> Column:
    """0, 1, 2 (two to four) or 3 (five or more)."""
    n = _c(n)
    return F.when(n == 0, 0).when(n == 1, 1).when(n < 5, 2).otherwise(3)


def combine_am_lm(pairs, mode="am_lm") -> Column:
    """Interleaved acoustic/language scores: one side or the mean of each pair."""
    p = _c(pairs)
    at = F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1)
    am = lambda i: F.get(p, i * 2)
    lm = lambda i: F.get(p, i * 2 + 1)
    pick = {"am": am, "lm": lm, "am_lm": lambda i: (am(i) + lm(i)) / 2}[mode]
    return F.when(F.size(p) < 2, F.array().cast("array<double>")).otherwise(F.transform(at, pick))


def header_positions(ids, scores, n=20) -> Column:
    """Header ids shifted by one and, with their scores, zero-padded to n."""
    return F.struct(
        pad_or_cut(F.transform(_c(ids), lambda i: (i + 1).cast("int")), n, F.lit(0)).alias("ids"),
        pad_or_cut(_c(scores), n, F.lit(0.0)).alias("scores"),
    )


def unflatten(ids, width: int, rows: int) -> Column:
    at = F.sequence(F.lit(0), F.lit(rows - 1))
    return let(_c(ids), lambda v: F.transform(at, lambda i: F.slice(v, i * width + 1, width)))


def tags_to_ids(tags, vocab) -> Column:
    """Ids by a literal ``map<string,int>``; unknown tags are dropped."""
    return F.filter(F.transform(_c(tags), lambda t: F.try_element_at(vocab, t)), lambda x: x.isNotNull())


def ids_to_tags(ids, names) -> Column:
    return F.filter(F.transform(_c(ids), lambda i: F.get(_c(names), i.cast("int"))), lambda x: x.isNotNull())


def literal_map(mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
