"""File readers. All return DataFrames; nothing is parsed on the driver, and no file is one task (``ranges``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colloquy import constants as K
from colloquy.sources.ranges import json_entries, numbered_lines

ACT_ARRAY = "array<array<string>>"
STATE = "map<string,map<string,string>>"
SESSION = (
    "struct<type:string,goal:array<array<string>>,messages:array<struct<role:string,content:string,"
    f"dialog_act:{ACT_ARRAY},user_state:array<array<string>>,sys_state:{STATE},sys_state_init:{STATE}>>>"
)


def read_sessions(spark: SparkSession, path: str, split: str) -> DataFrame:
    """JSON objects keyed by session id (optionally zipped): one row per session.

    A file is read in byte ranges and cut into sessions wherever it is; only a session has to fit in a task.
    """
    member = F.concat(F.lit("{"), "entry", F.lit("}"))
    sessions = json_entries(spark, path).select(F.explode(F.from_json(member, f"map<string,{SESSION}>")).alias("session_id", "s"))
    acts = lambda m: F.transform(
        m["dialog_act"],
        lambda a: F.struct(*[F.get(a, F.lit(i)).alias(n) for i, n in enumerate(("intent", "domain", "slot", "value"))]),
    )
    messages = F.transform(
        "s.messages",
        lambda m: F.struct(
            m["role"].alias("role"), m["content"].alias("content"), acts(m).alias("acts"),
            F.transform(m["user_state"], tuple5).alias("user_state"),
            m["sys_state"].alias("sys_state"), m["sys_state_init"].alias("sys_state_init"),
        ),
    )
    return sessions.select(
        F.lit(split).alias("split"), "session_id", F.col("s.type").alias("goal_type"),
        F.transform("s.goal", tuple5).alias("goal"), messages.alias("messages"),
    )


def tuple5(t) -> Column:
    """[id, domain, slot, value or list, expressed] -> struct with the value always a list."""
    value = F.get(t, F.lit(3))
    is_list = value.startswith("[")
    return F.struct(
        F.get(t, F.lit(0)).cast("int").alias("id"),
        F.get(t, F.lit(1)).alias("domain"),
        F.get(t, F.lit(2)).alias("slot"),
        F.when(is_list, F.from_json(value, "array<string>")).when(value == "", F.array().cast("array<string>"))
        .otherwise(F.array(value)).alias("value"),
        is_list.alias("is_list"),
        (F.get(t, F.lit(4)) == "true").alias("expressed"),
    )


def explode_turns(sessions: DataFrame, keep=("split", "session_id", "goal_type")) -> DataFrame:
    keep = [c for c in keep if c in sessions.columns]
    return sessions.select(*keep, F.posexplode("messages").alias("pos", "m")).select(*keep, "pos", "m.*")


def explode_acts(turns: DataFrame, acts="acts", keep=("session_id", "pos", "role")) -> DataFrame:
    return turns.select(*keep, F.posexplode_outer(acts).alias("act_ord", "a")).select(*keep, "act_ord", "a.*")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of [name, attributes] (or of attribute objects): (name, ord, attrs variant), last entry per name."""
    rows = json_entries(spark, path).select("ord", F.col("entry").alias("item"))
    item = F.parse_json("item")
    name = F.coalesce(F.try_variant_get(item, "$[0]", "string"), F.try_variant_get(item, f"$.{K.NAME}", "string"))
    attrs = F.when(F.col("item").startswith("["), F.try_variant_get(item, "$[1]", "variant")).otherwise(item)
    return last_per_name(rows.select(name.alias("name"), "ord", F.to_json(attrs).alias("attrs")))


def last_per_name(entities: DataFrame, name="name", order="ord") -> DataFrame:
    rest = [c for c in entities.columns if c != name]
    return entities.groupBy(name).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(name, "_r.*")


def split_fields(line, n: int | None = None, sep="\t") -> Column:
    """Strip the line, then split; stripping first means an empty last field is lost."""
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), sep)


def labelled_rows(lines: DataFrame, n_cols: int, order=None, text=1, value="value") -> DataFrame:
    """Lines with exactly ``n_cols`` tab fields and a non-empty text; ``order`` picks and reorders columns."""
    f = lines.withColumn("_f", split_fields(F.col(value)))
    kept = f.filter((F.size("_f") == n_cols) & (F.get("_f", F.lit(text)) != ""))
    picked = order if order is not None else range(n_cols)
    rest = [c for c in lines.columns if c != value]
    return kept.select(*rest, *[F.get("_f", F.lit(i)).alias(f"f{i}") for i in picked])


def read_labelled_tsv(spark, path, n_cols=3, order=None) -> DataFrame:
    return labelled_rows(spark.read.text(path), n_cols, order)


def asr_pair_rows(lines: DataFrame, transcript=1, asr=3, value="value", sep="\t") -> DataFrame:
    """Transcript, recognised text and label (last field) by column number."""
    f = F.split(F.trim(F.col(value)), sep)
    rest = [c for c in lines.columns if c != value]
    return lines.select(
        *rest,
        F.get(f, F.lit(transcript)).alias("transcript"),
        F.get(f, F.lit(asr)).alias("asr"),
        F.trim(F.element_at(f, -1)).alias("label"),
    )


def read_asr_pairs(spark, path, transcript=1, asr=3, sep="\t") -> DataFrame:
    return asr_pair_rows(spark.read.text(path), transcript, asr, sep=sep)


def label_text_rows(lines: DataFrame, value="value") -> DataFrame:
    """Last space-separated token is the label, the rest is the text; shorter lines are dropped."""
    line = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    rest = [c for c in lines.columns if c != value]
    f = lines.withColumn("_l", line).withColumn("_f", F.split("_l", " ")).filter(F.size("_f") >= 2)
    label = F.element_at("_f", -1)
    body = F.expr("substring(_l, 1, length(_l) - length(element_at(_f, -1)))")
    return f.select(*rest, F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"), label.alias("label"))


def read_label_text(spark, path) -> DataFrame:
    return label_text_rows(spark.read.text(path))


def read_vocab(spark, path, sep=" ") -> DataFrame:
    """(id, token): id is the line number (across a folder's files, in the order of their names), the token the first field."""
    lines = numbered_lines(spark, path, across=True)
    return lines.select(F.col("n").alias("id"), F.get(F.split("value", sep), F.lit(0)).alias("token"))


def read_vectors(spark, path, keyed=False, header=False) -> DataFrame:
    """Whitespace floats: ``(key, vec)``; the key is the first field or the line number. Blank lines hold no vector."""
    floats = lambda f: F.transform(f, lambda x: x.cast("double"))
    fields = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    if keyed:
        f = fields(F.col("value"))
        rows = spark.read.text(path).filter(F.size(f) > (2 if header else 1))
        return rows.select(F.get(f, F.lit(0)).alias("key"), floats(F.slice(f, 2, F.size(f))).alias("vec"))
    rows = numbered_lines(spark, path, across=True).filter(F.col("value").rlike(r"\S"))
    return rows.select(F.col("n").alias("key"), floats(fields(F.col("value"))).alias("vec"))


def with_extra_vectors(vectors: DataFrame, dim: int, count: int, extra=2, sd=0.1, seed=7) -> DataFrame:
    """Add the unknown and padding rows, drawn N(0, sd), with the next free ids."""
    more = vectors.sparkSession.range(extra).select(
        (F.col("id") + count).alias("key"), F.array(*[F.randn(seed + i) * sd for i in range(dim)]).alias("vec")
    )
    return vectors.select("key", "vec").unionByName(more)


def score_rows(lines: DataFrame, classes: int | None = None, value="value") -> DataFrame:
    """Key and class scores of tab-separated lines; the expected label is joined by key, never taken from position."""
    f = F.split(F.trim(F.col(value)), "\t")
    n = F.lit(classes) if classes else F.size(f)
    rest = [c for c in lines.columns if c != value]
    return lines.select(*rest, F.get(f, F.lit(0)).alias("key"), F.transform(F.slice(f, F.lit(2), n), lambda x: x.cast("double")).alias("scores"))


def read_scores(spark, path) -> DataFrame:
    return score_rows(spark.read.text(path))


def ontology_slots(keys: DataFrame, key="key", domains=K.EXPERIMENT_DOMAINS) -> DataFrame:
    """Slots of experiment domains; spaces go (and case folds) unless the key speaks of booking."""
    k = F.col(key)
    slot = F.when(k.contains("book"), F.lower(k)).otherwise(F.lower(F.replace(k, F.lit(" "), F.lit(""))))
    return keys.filter(F.get(F.split(k, "-"), F.lit(0)).isin(*domains)).select(key, slot.alias("slot"))


def read_ontology(spark, path) -> DataFrame:
    # an ontology holds one key per slot: a document as small as the data model
    keys = spark.read.text(path, wholetext=True).select(
        F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("key")
    )
    return ontology_slots(keys)

