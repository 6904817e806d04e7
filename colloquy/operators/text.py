"""Tokenising, normalising and error rates over whole texts."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.binding import let
from colloquy.operators.staging import stage

# -- fixed values: character classes of the basic tokeniser -----------------------------
CJK = r"[一-鿿㐀-䶿豈-﫿\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2F800}-\x{2FA1F}]"
SPACE = r"[\t\n\r\p{Zs}]"
CONTROL = r"[\x{FFFD}\p{C}&&[^\t\n\r]]"
PUNCT = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}]"


def _accented() -> dict[str, str]:
    """Every character whose canonical form is one base character and marks, with that base."""
    found = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        form = unicodedata.normalize("NFD", c)
        if len(form) > 1 and unicodedata.category(form[0]) != "Mn" and all(unicodedata.category(m) == "Mn" for m in form[1:]):
            found[c] = form[0]
    return found


_BASES = _accented()
ACCENTED, PLAIN = "".join(_BASES), "".join(_BASES.values())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_accents(text) -> Column:
    """Accents removed in every script, precomposed or combining."""
    return F.regexp_replace(F.translate(_c(text), ACCENTED, PLAIN), r"\p{Mn}", "")


def basic_tokens(text, keep="marks") -> Column:
    """Clean, isolate CJK characters, lower-case, strip accents and split punctuation.

    ``keep='marks'`` leaves ``[SEP]`` and ``unused*`` tokens whole; ``keep='underscore'``
    leaves tokens with ``_`` whole and treats ``_`` as a letter.
    """
    t = F.regexp_replace(_c(text), CONTROL, "")
    t = F.regexp_replace(t, SPACE, " ")
    t = F.regexp_replace(t, f"({CJK})", " $1 ")
    punct = PUNCT if keep == "marks" else r"[\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E\p{P}&&[^_]]"

    def split_text(w):
        spaced = F.regexp_replace(strip_accents(F.lower(w)), f"({punct})", " $1 ")
        return F.filter(F.split(spaced, " "), lambda x: x != "")

    kept = (lambda w: (w == "[SEP]") | w.contains("unused")) if keep == "marks" else (lambda w: w.contains("_"))
    marked = (lambda w: w.contains("[SEP]") | w.contains("unused")) if keep == "marks" else (lambda w: w.contains("_"))
    by_token = lambda c: F.flatten(
        F.transform(
            F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.when(kept(w), F.array(w)).otherwise(split_text(w))
        )
    )
    # only texts that hold a kept token go token by token
    return let(t, lambda c: F.when(marked(c), by_token(c)).otherwise(split_text(c)))


def normalize_string(text) -> Column:
    """Lower, strip accents, space around , . ! ?, other characters to one space."""
    t = strip_accents(F.regexp_replace(F.lower(_c(text)), r"^\s+|\s+$", ""))
    body = F.regexp_replace(t, r"([,.!?])", " $1 ")
    body = F.regexp_replace(body, r"[^a-zA-Z,.!?]+", " ")
    body = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(t == "<silence>", t).otherwise(body)


def whitespace_segment(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def expand_contractions(tokens, pairs) -> Column:
    """Replace tokens by a ``from -> to`` table given as a literal map column."""
    return F.transform(_c(tokens), lambda t: F.coalesce(F.try_element_at(pairs, t), t))


_CODES = 1_000_000  # tokens of a pair become characters from U+3401 on, without the surrogates


def _as_chars(tokens, code) -> Column:
    """Tokens as characters of one string, so that edit distance runs inside the JVM; ``code`` counts from 1.

    The string is decoded once, not token by token.
    """

    def point(t):
        at = code(t) + 0x3400
        at = F.when(at < 0xD800, at).otherwise(at + 0x800)
        return F.when(at <= 0x10FFFF, at).otherwise(F.raise_error(F.lit("too many distinct tokens in one pair")).cast("bigint"))

    digits = F.transform(tokens, lambda t: F.lpad(F.hex(point(t)), 8, "0"))
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-32")


def edit_distance(a, b) -> Column:
    """Token Levenshtein distance of two arrays.

    A token's character is a hash of it, found without a search; a pair in which two tokens share a hash
    takes the tokens' places in the list of its distinct ones instead.
    """
    hashed = lambda t: F.pmod(F.xxhash64(t), F.lit(_CODES)) + 1
    distance = lambda p, code: F.levenshtein(_as_chars(p["a"], code), _as_chars(p["b"], code))

    def compared(p, types):
        clear = F.size(F.array_distinct(F.transform(types, hashed))) == F.size(types)
        return F.when(clear, distance(p, hashed)).otherwise(distance(p, lambda t: F.array_position(types, t)))

    pair = F.struct(_c(a).alias("a"), _c(b).alias("b"))
    return let(pair, lambda p: let(F.array_distinct(F.concat(p["a"], p["b"])), lambda types: compared(p, types)))


def wer(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Edits, reference length and error rate per row; an empty reference has no rate."""
    d = df.withColumn("edits", edit_distance(ref, hyp).cast("bigint")).withColumn("ref_len", F.size(ref).cast("bigint"))
    return d.withColumn("wer", F.when(F.col("ref_len") > 0, F.round(F.col("edits") / F.col("ref_len") * 100, 6)))


def corpus_wer(rated: DataFrame, by=()) -> DataFrame:
    return rated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len"),
        F.round(F.sum("edits") / F.sum("ref_len") * 100, 6).alias("wer"),
    )


def split_delex(text, segment=None) -> Column:
    """Tokens around ``[placeholders]``, which stay whole."""
    spaced = F.regexp_replace(_c(text), r"(\[[^\[^\]]+\])", "\u0001$1\u0001")
    words = segment or (lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    return F.flatten(
        F.transform(
            F.filter(F.split(spaced, "\u0001"), lambda p: p != ""),
            lambda p: F.when(p.rlike(r"^\[[^\[^\]]+\]$"), F.array(p)).otherwise(words(p)),
        )
    )


BLOCK_TOKENS = 1 << 23  # rows with about so many tokens share one dictionary
BLOCKS = 32  # at least, so that small inputs spread too
ENTRY, KEYED, UNKEYED = 0, 1, 2  # of a block: tokens with the sizes of their pieces, then rows, last rows without a key


def wordpiece(df: DataFrame, tokens: str, vocab: DataFrame, key, out="pieces", unk="[UNK]", longest=100, place=None) -> DataFrame:
    """Greedy longest-match pieces with ``##`` continuations; an empty token has no pieces.

    Every distinct token lists its substrings up to the longest vocabulary piece; an
    equi-join keeps those in the vocabulary; the longest match per start is followed from
    position 1. Only distinct tokens are cut, then looked up per row.

    Rows are dealt to blocks, and a block asks once for each of its distinct tokens. So what is shuffled beside the rows are
    the dictionaries of the blocks, not a row per text and token, and no token has more rows than there are blocks. ``place``
    names a column in which rows that are stored together have near numbers, as ``monotonically_increasing_id`` gives them
    while a table is staged; without it rows are dealt by a hash. A row with a null in ``key`` finds no token.
    """
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(tokens)).alias("tokens")).first()
    per = max(1, size.rows // max(BLOCKS, (size.tokens or 0) // BLOCK_TOKENS))
    at = F.coalesce(F.col(place), F.lit(0)) if place else F.pmod(F.xxhash64(*key, tokens), F.lit(max(1, size.rows)))
    keyed = reduce(and_, [F.col(k).isNotNull() for k in key])
    blocks = df.withColumn("_block", at - F.pmod(at, F.lit(per))).withColumn("_kind", F.when(keyed, KEYED).otherwise(UNKEYED))
    need = blocks.filter(F.col("_kind") == KEYED).select("_block", F.explode(F.array_distinct(tokens)).alias("token"))
    need = stage(need.filter("token <> ''").distinct())

    types = need.select("token").distinct()
    widest = vocab.agg(F.max(F.length(F.regexp_replace("token", "^##", ""))).cast("int").alias("_w"))
    n = F.length("token")
    starts = types.filter(n <= longest).crossJoin(F.broadcast(widest)).select("token", "_w", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    pieces = starts.select("token", "s", F.explode(F.sequence(F.lit(1), F.least("_w", n - F.col("s") + 1))).alias("l")).withColumn(
        "piece", F.concat(F.when(F.col("s") > 1, "##").otherwise(""), F.substring(F.col("token"), F.col("s"), F.col("l")))
    )
    best = pieces.join(vocab.select(F.col("token").alias("piece")).distinct(), "piece", "left_semi").groupBy("token", "s").agg(F.max("l").alias("l"))
    steps = best.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("s", "l"))).alias("m"))
    walk = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, i: F.when(
            (a["at"] == i) & F.try_element_at("m", i).isNotNull(),
            F.struct(
                (i + F.try_element_at("m", i)).alias("at"),
                F.array_append(a["out"], F.octet_length(F.substring(F.col("token"), i, F.try_element_at("m", i)))).alias("out"),
            ),
        ).otherwise(a),
    )
    # a token that cannot be cut is left out, as unknown as one that the vocabulary does not begin
    cut = steps.withColumn("_a", walk).filter(F.col("_a.at") == n + 1).select("token", F.col("_a.out").alias("_sizes"))

    # a block's entries come before its rows; both are a string and the bytes of its parts, which takes less room than arrays
    entries = need.join(cut, "token").select("_block", F.lit(ENTRY).alias("_kind"), F.col("token").alias("_text"), "_sizes")
    sizes = F.transform(tokens, lambda t: F.coalesce(F.octet_length(t), F.lit(-1)))
    rows = blocks.withColumn("_text", F.array_join(tokens, "")).withColumn("_sizes", sizes)
    dealt = rows.unionByName(entries, allowMissingColumns=True).repartition("_block").sortWithinPartitions("_block", "_kind")
    found = dealt.withColumn("_found", _joined_lists(unk)("_block", "_kind", "_text", "_sizes")).filter(F.col("_kind") != ENTRY)
    return found.select(*[c for c in df.columns if c != out], F.col("_found").alias(out))


def _joined_lists(unk: str):
    """The lists of a row's tokens in a row: ``unk`` for a token without one, nothing for an empty token.

    Reads the entries of a block, then its rows, whose tokens are looked up by hash among them. It depends on that order, so
    it is no deterministic function to Spark, which else might drop the entries before they are read.
    """

    def parts(texts: pa.Array, sizes: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, null where the size is negative, and the place in them where each text begins and the last ends."""
        lengths = sizes.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))]).astype("int32")
        begin = int(np.frombuffer(texts.buffers()[1], "int32")[texts.offset])
        known, data = pa.array(lengths >= 0).buffers()[1], (texts.buffers()[2] or pa.py_buffer(b"")).slice(begin)
        counts = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy()
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), data, known), np.concatenate([[0], np.cumsum(counts)])

    def dictionary(entries: list) -> tuple[pa.Array, pa.Array]:
        names, cuts = (pa.concat_arrays(x) for x in zip(*entries))
        pieces, begins = parts(names, cuts)
        later = np.ones(len(pieces), bool)
        later[begins[:-1]] = False  # an entry has a piece at least
        pieces = pc.if_else(pa.array(later), pc.binary_join_element_wise("##", pieces, ""), pieces)
        return names, pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pieces)

    def listed(texts: pa.Array, sizes: pa.Array, names: pa.Array, lists: pa.Array) -> pa.Array:
        words, begins = parts(texts, sizes)
        unknown = len(names)
        place = pc.fill_null(pc.index_in(words, value_set=names, skip_nulls=True), unknown)
        place = pc.if_else(pc.fill_null(pc.equal(words, ""), False), unknown + 1, place)
        taken = pa.concat_arrays([lists, pa.array([[unk], []], lists.type)]).take(place)
        ends = np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends[begins], pa.int32()), taken.flatten(), mask=sizes.is_null())

    def look_up(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        none = pa.array([], pa.string()), pa.array([], pa.list_(pa.string()))
        current, entries, held = None, [], none
        for block, kind, text, sizes in batches:
            b, k = block.to_numpy(), kind.to_numpy()
            part = np.cumsum(pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(), dtype="int64") >> 20  # about a million tokens at once
            bounds = [0, *(np.flatnonzero((np.diff(b) != 0) | (np.diff(k) != 0) | (np.diff(part) != 0)) + 1), len(b)]
            for i, j in zip(bounds, bounds[1:]):
                if b[i] != current:
                    current, entries, held = b[i], [], none
                if k[i] == ENTRY:
                    entries.append((text.slice(i, j - i), sizes.slice(i, j - i)))
                    yield pa.nulls(j - i, pa.list_(pa.string()))
                    continue
                if entries:
                    held, entries = dictionary(entries), []
                yield listed(text.slice(i, j - i), sizes.slice(i, j - i), *(held if k[i] == KEYED else none))

    return F.arrow_udf(look_up, "array<string>").asNondeterministic()
