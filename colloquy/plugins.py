"""Extension points: user models, trackers and tokenisers.

A model is built once per task from a factory and then fed Arrow batches.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colloquy.operators import bayes

ACTS = "array<struct<intent:string,domain:string,slot:string,value:string>>"


def predict_acts(df: DataFrame, make: Callable[[], Callable], text="content", context="context", out="pred") -> DataFrame:
    """``make()`` returns ``f(text, context) -> [(intent, domain, slot, value), ...]``."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(ACTS))])

    def run(batches: Iterator):
        model = make()
        for pdf in batches:
            rows = [model(t, list(c) if c is not None else []) for t, c in zip(pdf[text], pdf[context])]
            pdf[out] = [[dict(zip(("intent", "domain", "slot", "value"), a)) for a in r] for r in rows]
            yield pdf

    return df.mapInPandas(run, schema)


def track_sessions(turns: DataFrame, make: Callable[[], Callable], schema: str, session="session_id") -> DataFrame:
    """Custom batch tracker: ``make()`` returns ``f(state, role, acts) -> (state, row or None)``.

    Sessions are laid out in order inside their partitions and streamed through the
    function batch by batch, so memory holds one state, never a whole session. A user fold
    is sequential by nature; the built-in tracker splits long sessions instead.
    """
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def fold(batches):
        step, current, state = make(), None, None
        for pdf in batches:
            rows = []
            for key, pos, role, acts in zip(pdf[session], pdf["pos"], pdf["role"], pdf["acts"]):
                if key != current:
                    current, state = key, None
                state, row = step(state, role, [tuple(a.values()) if isinstance(a, dict) else tuple(a) for a in acts])
                if row is not None:
                    rows.append((key, pos, *row))
            yield pd.DataFrame(rows, columns=names)

    laid_out = turns.select(session, "pos", "role", "acts").repartition(session).sortWithinPartitions(session, "pos")
    return laid_out.mapInPandas(fold, schema)


def tokenizer(make: Callable[[], Callable]) -> Callable[[Column], Column]:
    """Column function from ``make() -> f(text) -> list[str]``, usable wherever a tokeniser is asked for."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for s in batches:
            yield pd.Series([f(t) if t is not None else None for t in s])

    return cut


def intent_baseline(train: DataFrame, test: DataFrame, tokens="tokens", label="label", weights=None, key=("id",)) -> DataFrame:
    """Class scores of a naive Bayes text classifier: ``test`` plus ``scores`` and ``pred`` columns.

    All tokens of ``train`` count, each as itself; ``weights(label, weight)`` balances the classes.
    """
    return bayes.scores(bayes.fit(train, tokens, label, weights), test, tokens, key)
