"""Quality rules, line first: judge every line, drop the failing ones, then judge what a document lost.

Only built-in functions: one scan, no shuffle, and a document is one row, so no key can be hot.
A null text counts as empty. Added columns start with ``q_``, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GAP = r"[\x20\x09-\x0D]+"
# Wording of lines that carry no content.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for",
    "click here to",
    "lorem ipsum",
)
# A line fails when one of these matches it.
LINE_RULES = {
    "boilerplate": r"(?i)\b(?:" + "|".join(BOILERPLATE) + r")\b",
    "navigation": r"(?:[|»›•][^|»›•]*){3}",
    "symbols": r"(?:[#*$%&|<>]{2,}[^#*$%&|<>]*){3}",
}
# So does one without small letters that has capitals before and after a gap. Each part of the pattern stops at the first
# character the next part takes, so matching is linear in the line.
SMALL_LETTER = r"\p{Ll}"
SHOUTING = r"^[^\p{Lu}]*\p{Lu}[^\x20\x09]*[\x20\x09][^\p{Lu}]*\p{Lu}"
ENDS_WELL = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
SHORT_LINE = 20
MAX_LOST_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def once(value: Column, where: Column | None = None) -> Column:
    """``value`` as a column that the optimizer never copies into the expressions that use it.

    A filter on a result would else be pushed below it, and the arrays be built anew for each of their elements.
    """
    always = F.spark_partition_id() >= 0
    return F.when(always if where is None else always & where, value)


def bad_line(line: Column) -> Column:
    """True for a non-blank line that a rule rejects; a short line must also end as a sentence does."""
    bad = (F.length(line) < SHORT_LINE) & ~line.rlike(ENDS_WELL)
    for pattern in LINE_RULES.values():
        bad = bad | line.rlike(pattern)
    return bad | (~line.rlike(SMALL_LETTER) & line.rlike(SHOUTING))


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``q_clean`` (the text without failing lines) and ``q_lost_percent`` (share of non-space characters gone).

    Blank lines stay. An empty text loses nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    solid = lambda c: F.length(F.regexp_replace(c, GAP, ""))
    out = docs.withColumn("q_clean", F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & bad_line(x))), "\n"))
    whole = solid(text)
    return out.withColumn("q_lost_percent", F.when(whole == 0, F.lit(0.0)).otherwise((whole - solid(F.col("q_clean"))) * 100.0 / whole))


def base_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add word, symbol, repeated-line and repeated-word counts over whole texts.

    ``q_n_repeat_words`` counts the words that lie in a three-word window found at least twice. Hashes of the
    windows only tell whether any window can repeat; the windows themselves decide, by one sort per document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("q_words", once(words_of(text))).withColumn("q_n_words", F.size("q_words"))
    at = lambda i, k: F.get(F.col("q_words"), i + k)
    starts = F.sequence(F.lit(0), F.col("q_n_words") - 3)
    long_enough = F.col("q_n_words") >= 4
    hashes = F.transform(starts, lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))
    out = out.withColumn("q_hashes", F.when(long_enough, hashes))
    may_repeat = F.size(F.array_distinct("q_hashes")) < F.size("q_hashes")
    windows = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("w"), i.alias("i")))
    out = out.withColumn("q_windows", once(F.sort_array(windows), long_enough & may_repeat))
    near = lambda k: F.get(F.col("q_windows"), k)["w"]
    twice = F.filter("q_windows", lambda x, k: F.coalesce(near(k - 1) == x["w"], F.lit(False)) | F.coalesce(near(k + 1) == x["w"], F.lit(False)))
    covered = F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + 2)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        out.withColumn("q_n_repeat_words", once(F.coalesce(F.when(F.col("q_windows").isNotNull(), F.size(F.array_distinct(covered))), F.lit(0))))
        .withColumn("q_lines", lines)
        .withColumn("q_n_dup_lines", F.size("q_lines") - F.size(F.array_distinct("q_lines")))
        .withColumn("q_word_chars", F.length(F.array_join("q_words", "")))
        .withColumn("q_n_symbols", F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", "")))
        .drop("q_words", "q_hashes", "q_windows", "q_lines")
    )


def quality_rules(docs: DataFrame, text_col: str = "text", max_lost_percent: float = MAX_LOST_PERCENT) -> DataFrame:
    """All ``q_`` columns plus ``q_base_failed`` and ``q_kept``; every input row stays, repeated rows included."""
    out = clean_lines(base_metrics(docs, text_col), text_col)
    failed = (F.col("q_n_words") < 50) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * 50)
    return out.withColumn("q_base_failed", once(failed)).withColumn("q_kept", once(~F.col("q_base_failed") & (F.col("q_lost_percent") <= max_lost_percent)))


def report(docs: DataFrame) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules(docs.select("doc_id", "text")).select(
        "doc_id", *[F.col(f"q_{c}").cast("long").alias(c) for c in counts], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept")
    )


def _sql_bad_line() -> str:
    rules = [f"regexp_matches(l, '{p.replace(chr(39), chr(39) * 2)}')" for p in LINE_RULES.values()]
    ends = ENDS_WELL.replace("'", "''")
    rules.append(f"(NOT regexp_matches(l, '{SMALL_LETTER}') AND regexp_matches(l, '{SHOUTING}'))")
    return " OR ".join([*rules, f"(length(l) < {SHORT_LINE} AND NOT regexp_matches(l, '{ends}'))"])


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '') AS w FROM documents),
 win AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 4)),
 rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) >= 2),
 cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY r),
 ln AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
 ls AS (SELECT r, count(*) - count(DISTINCT l) AS dup,
               sum(length(regexp_replace(l, '{GAP}', '', 'g'))) FILTER (WHERE {_sql_bad_line()}) AS lost
        FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
 m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
              (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
              coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
       FROM d LEFT JOIN cov USING (r) LEFT JOIN ls USING (r)),
 b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (word_chars = 0 OR lost * 100.0 / word_chars <= {MAX_LOST_PERCENT}) AS kept
FROM b
"""
