"""Plug-in points for models.

A plug-in is any callable from columns to a column: a precomputed column, a
built-in expression, or a vectorised UDF made by :func:`batch_model`.  No model
ships with the package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .. import config as C

Scorer = Callable[..., Column]


def batch_model(
    load: Callable[[], Callable[..., list]],
    return_type: str,
    batch_size: int = 64,
    on_error: str = "raise",
) -> Scorer:
    """Wrap a model as an iterator Pandas UDF.

    ``load`` runs once per Python worker and returns a function over parallel
    lists.  Rows with a NULL input never reach the model, which is how
    :func:`only_where` keeps costly stages off rows already decided.
    ``on_error='null'`` turns a failing batch into NULLs.  A model of a
    ``struct<...>`` type returns dicts (and needs a session when it is wrapped);
    its rows without a result are structs of NULLs.
    """
    if on_error not in ("raise", "null"):
        raise ValueError("on_error must be 'raise' or 'null'")

    struct = return_type.strip().lower().startswith("struct<")
    fields = DataType.fromDDL(return_type).names if struct else []

    def column(out: list) -> pd.Series | pd.DataFrame:
        if not struct:
            return pd.Series(out, dtype=object)
        return pd.DataFrame({f: pd.Series([None if row is None else row[f] for row in out], dtype=object) for f in fields})

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = None
        for batch in batches:
            columns = (batch,) if isinstance(batch, pd.Series) else batch
            wanted = pd.concat([c.notna() for c in columns], axis=1).all(axis=1).to_numpy()
            rows = wanted.nonzero()[0]
            out: list = [None] * len(wanted)
            if len(rows) and model is None:
                model = load()
            for start in range(0, len(rows), batch_size):
                part = rows[start:start + batch_size]
                try:
                    scores = model(*[c.iloc[part].tolist() for c in columns])
                except Exception:
                    if on_error == "raise":
                        raise
                    continue
                for position, score in zip(part, scores):
                    out[position] = score
            yield column(out)

    run.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, ...]],
        "return": Iterator[pd.DataFrame if struct else pd.Series],
    }
    return F.pandas_udf(run, return_type)


def only_where(mask: Column, scorer: Scorer, *inputs: Column) -> Column:
    """Apply ``scorer`` where ``mask`` holds; other rows hand it NULLs and get NULL.

    Spark evaluates a Python UDF for every row of a projection, also inside a
    ``CASE WHEN``, so the inputs are nulled instead of the output.
    """
    return F.when(mask, scorer(*[F.when(mask, c) for c in inputs]))


def placeholder_answer(query: Column) -> Column:
    """Answer text used when no answerer is given."""
    before, after = C.ANSWER_PLACEHOLDER.split("{query}")
    return F.concat(F.lit(before), query, F.lit(after))


@dataclass(frozen=True)
class Plugins:
    """Models of the cascade.

    rewriter(prompt) -> query; embedder(query) -> vector;
    classifier(query) -> struct<label, confidence>;
    reranker(query, cached query) -> score;
    contradiction(a, b) -> logit, called in both directions;
    relevance(query, clipped answer) -> score;
    judge(signal, prompt) -> reply text; answerer(query, messages) -> text.
    """

    rewriter: Scorer | None = None
    embedder: Scorer | None = None
    classifier: Scorer | None = None
    reranker: Scorer | None = None
    contradiction: Scorer | None = None
    relevance: Scorer | None = None
    judge: Scorer | None = None
    answerer: Scorer | None = None
