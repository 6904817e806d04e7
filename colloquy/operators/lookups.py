"""Vocabulary, embedding and template lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy import constants as K
from colloquy.operators.ordered import dense_position
from colloquy.operators.staging import stage


HOT_SHARE = 4096  # a key with more than one in so many rows is spread
COPIES = 32


def spread_join(rows: DataFrame, table: DataFrame, key: str, by, share: int = HOT_SHARE, copies: int = COPIES) -> DataFrame:
    """Inner join on ``key`` whose frequent keys lie in ``copies`` tasks each; the result is that of the plain join.

    A key is frequent when it holds more than one in ``share`` of ``rows``. Fewer than ``share`` keys can, whatever the
    data, so their list may be broadcast. Rows of a frequent key are dealt by a hash of the columns ``by``, and the rows
    of ``table`` with that key are repeated for each place. Null keys match nothing.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * share > F.col("_total")).select(key, F.lit(True).alias("_hot"))
    place = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(copies))).otherwise(F.lit(0).cast("bigint"))
    places = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_place", place).drop("_hot")
    repeated = table.join(F.broadcast(hot), key, "left").withColumn("_place", F.explode(places)).drop("_hot")
    return dealt.join(repeated, [key, "_place"]).drop("_place")


def token_maps(df: DataFrame, tokens: str, table: DataFrame, key, out="_m") -> DataFrame:
    """Each row with a small map of its own tokens: ``table(token, value)`` gives the entries, other tokens have none.

    Each distinct token of a row is looked up once and the map is then applied inside the row, so nothing is ordered
    or regrouped token by token. A null array and an empty one get an empty map. Rows are told apart by ``key``.
    """
    keys = list(key)
    need = df.select(*keys, F.explode(F.array_distinct(tokens)).alias("token"))
    known = (
        spread_join(need, table.select("token", F.col("value").alias("_value")), "token", keys)
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "_value"))).alias(out))
    )
    empty = F.create_map().cast(known.schema[out].dataType)
    return df.join(known, keys, "left").withColumn(out, F.coalesce(out, empty))


def token_ids(df: DataFrame, tokens: str, vocab: DataFrame, unk: int, key, out="ids", append=()) -> DataFrame:
    """Token array -> id array with ``unk`` for tokens outside ``vocab(token, id)``.

    ``append`` adds fixed ids (for instance an end mark).
    """
    mapped = token_maps(df, tokens, vocab.select("token", F.col("id").cast("int").alias("value")), key)
    tail = F.array(*[F.lit(x) for x in append]).cast("array<int>")
    ids = F.transform(F.col(tokens), lambda t: F.coalesce(F.try_element_at("_m", t), F.lit(unk)))
    return mapped.withColumn(out, F.concat(ids, tail)).drop("_m")


def attach_vectors(vocab: DataFrame, vectors: DataFrame, key: str, dim: int, default=0.0) -> DataFrame:
    """Vector per vocabulary row, a constant vector where there is none; ``hit`` tells which."""
    return (
        vocab.join(vectors.select(key, F.col("vec").alias("_v")), key, "left")
        .withColumn("hit", F.col("_v").isNotNull())
        .withColumn("vec", F.coalesce("_v", F.array_repeat(F.lit(float(default)), dim)))
        .drop("_v")
    )


def coverage(attached: DataFrame) -> DataFrame:
    return attached.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("hit").cast("bigint")).alias("hits"),
        F.round(F.avg(F.col("hit").cast("double")) * 100, 4).alias("coverage"),
    )


def item_pairs(rows: DataFrame, key: str, item: str, min_support: int = 1, part: int = 256) -> DataFrame:
    """(item, other, n): in how many lists two different items lie together, both directions.

    ``rows(key, item)`` holds one row per list element; null items count nowhere. An item in fewer than ``min_support``
    lists cannot be in a pair of that many and leaves before pairs are formed; pairs below it leave afterwards. Lists of
    up to ``part`` items form their pairs inside a row, equal ones only once. The items of a longer list are dealt into parts
    of about ``part`` and every two parts meet on their own, so that it spreads over many tasks and none holds its square.
    """
    distinct = rows.filter(F.col(item).isNotNull()).select(F.col(key).alias("key"), F.col(item).alias("item")).distinct()
    distinct = stage(distinct)
    if min_support > 1:
        common = distinct.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_support).select("item")
        distinct = distinct.join(common, "item", "left_semi")
    long = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > part)
    long = stage(long.select("key", F.ceil(F.col("_size") / part).cast("int").alias("parts")))
    short = distinct.join(long, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("_d"))
    short = short.groupBy("_d").agg(F.count(F.lit(1)).alias("times"))
    inside = short.select(F.explode("_d").alias("item"), "_d", "times").select("item", F.explode("_d").alias("other"), "times")
    held = distinct.join(long, "key").withColumn("p", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    left = held.select("key", "item", "p", F.explode(others).alias("q"))
    right = held.select("key", F.col("item").alias("other"), F.col("p").alias("q"), F.explode(others).alias("p"))
    across = left.join(right, ["key", "p", "q"]).select("item", "other", F.lit(1).cast("bigint").alias("times"))
    pairs = inside.unionByName(across).filter("item <> other").groupBy("item", "other").agg(F.sum("times").alias("n"))
    return pairs.filter(F.col("n") >= min_support) if min_support > 1 else pairs


def cooccurrence(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(item, other) distinct pairs of items sharing a list; items that occur once overall are no keys."""
    frequent = rows.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return item_pairs(rows, key, item).select("item", "other").join(frequent.select("item"), "item", "left_semi")


def edge_weights(rows: DataFrame, key: str, item: str, min_support: int = 2) -> DataFrame:
    """(item, other, n, pmi): positive pointwise mutual information of items that share lists, ``item`` the smaller one.

    Shares are of lists: ``ln(n * lists / (lists with item * lists with other))``. Pairs in fewer than ``min_support``
    lists and those without a positive value have no edge.
    """
    rows = rows.filter(F.col(item).isNotNull())
    held = rows.select(F.col(key).alias("key"), F.col(item).alias("item")).distinct()
    sizes = held.groupBy("item").agg(F.count(F.lit(1)).alias("_size"))
    lists = held.agg(F.count_distinct("key").alias("_lists"))
    pairs = item_pairs(rows, key, item, min_support).filter("item < other")
    sized = pairs.join(sizes, "item").join(sizes.select(F.col("item").alias("other"), F.col("_size").alias("_other")), "other")
    value = F.log(F.col("n") * F.col("_lists").cast("double") / (F.col("_size").cast("double") * F.col("_other").cast("double")))
    return sized.crossJoin(F.broadcast(lists)).select("item", "other", "n", F.round(value, 6).alias("pmi")).filter("pmi > 0")


def label_edges(rows: DataFrame, token: str, label: str, key: str, min_support: int = 2) -> DataFrame:
    """(token, label, n, weight): rarity-weighted counts between tokens and labels.

    ``rows(key, token, label)`` holds one row per occurrence. ``n`` counts occurrences of the token under the label,
    ``weight`` is ``n * ln(keys / keys with the token)``. Tokens found under fewer than ``min_support`` keys have no edge.
    """
    known = rows.filter(F.col(token).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(token).alias("token"), F.col(label).alias("label"))
    counts = known.groupBy("token", "label", "key").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.groupBy("token", "label").agg(F.sum("n").alias("n"))
    spread = counts.select("token", "key").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("_keys")).filter(F.col("_keys") >= min_support)
    total = known.agg(F.count_distinct("key").alias("_total"))
    return edges.join(spread, "token").crossJoin(F.broadcast(total)).select(
        "token", "label", "n", F.round(F.col("n") * F.log(F.col("_total") / F.col("_keys")), 6).alias("weight")
    )


def kb_type_values(triples: DataFrame, name_type="R_restaurant") -> DataFrame:
    """(type, value, ord): distinct values of a type in first-seen order; entity names form a type of their own.

    ``triples(ord, name, relation, value)``. The value order is ``first``, the smallest input position.
    """
    named = triples.select(F.lit(name_type).alias("type"), F.col("name").alias("value"), "ord")
    typed = triples.select(F.col("relation").alias("type"), "value", "ord")
    return named.unionByName(typed).groupBy("type", "value").agg(F.min("ord").alias("first"))


def type_order(type_values: DataFrame, name_type="R_restaurant") -> DataFrame:
    """(type, type_ord): the name type first, the others by first appearance."""
    first = type_values.groupBy("type").agg(F.min("first").alias("first"))
    rank = F.when(F.col("type") == name_type, F.lit(-1)).otherwise(F.col("first"))
    return first.select("type", rank.alias("type_ord"))


def delexicalize_sentences(df: DataFrame, tokens: str, type_values: DataFrame, key, skip=("R_rating",)) -> DataFrame:
    """Replace each known word by the name of its first type (ratings excepted)."""
    order = type_order(type_values)
    word_type = (
        type_values.filter(~F.col("type").isin(*skip))
        .join(order, "type")
        .groupBy("value")
        .agg(F.min_by("type", F.struct("type_ord", "type")).alias("type"))
    )
    mapped = token_maps(df, tokens, word_type.select(F.col("value").alias("token"), F.col("type").alias("value")), key)
    swapped = F.transform(F.col(tokens), lambda t: F.coalesce(F.try_element_at("_m", t), t))
    return mapped.withColumn("delex", F.array_join(swapped, " ")).drop("_m")


def domain_id(domain, table=None) -> Column:
    """Fixed id of a turn domain; unknown names take the first entry."""
    table = table or K.TURN_DOMAIN_IDS
    d = F.col(domain) if isinstance(domain, str) else domain
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, d), F.lit(next(iter(table.values()))))


def attach_text_and_features(split: DataFrame, text: DataFrame, features: DataFrame, key) -> DataFrame:
    """Turns of a split with text and features; turns lacking either are dropped."""
    return split.join(text, list(key)).join(features, list(key))


def select_template(turns: DataFrame, library: DataFrame, key: str, turn_key, seed=0, out="template") -> DataFrame:
    """Seeded choice of one template per turn among those stored for its key; null on a miss.

    ``library(key, template)``. Templates get a dense number per key, the turn picks a
    number (in hash order, chunk by chunk), and the two meet in an equi-join on
    (key, number), so a popular key is spread over its templates.
    """
    known = library.select(key, "template").distinct().withColumn("_m", F.md5("template"))
    numbered = dense_position(known, [key], ["_m", "template"], F.substring("_m", 1, 3), out="_i").drop("_m")
    sizes = numbered.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *turn_key)), 1, 8), 16, 10).cast("bigint")
    return (
        turns.join(sizes, key, "left")
        .withColumn("_i", pick % F.col("_n"))
        .join(numbered.withColumnRenamed("template", out), [key, "_i"], "left")
        .drop("_i", "_n")
    )
