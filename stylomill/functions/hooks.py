"""Scorers of the user's own as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scorer(make: Callable[[], Callable[..., pd.Series]], kind: str = "double") -> Callable[..., Column]:
    """A function of columns that runs a scorer of pandas Series on Arrow batches.

    make() is called once a task, so that a scorer loads what it needs once, and returns a function of one Series for
    each column that gives a Series of as many rows. Nulls come as None or NaN; what the scorer makes of them is the result.
    """

    def over(*columns: Column | str) -> Column:
        if len(columns) == 1:

            @F.pandas_udf(kind)
            def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                f = make()
                for b in batches:
                    yield f(b)

            return one(*columns)

        @F.pandas_udf(kind)
        def several(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            f = make()
            for b in batches:
                yield f(*b)

        return several(*columns)

    return over


def subword_ids(path: str, length: int = 512, pad: int = 0) -> Callable[[Column | str], Column]:
    """A function of a text column: ids of a tokenizers vocabulary file, cut to length and padded to it. Null counts as empty. The file must be on the workers."""

    def make() -> Callable[[pd.Series], pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding(), t.no_truncation()

        def ids(texts: pd.Series) -> pd.Series:
            found = (e.ids[:length] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False))
            return pd.Series([x + [pad] * (length - len(x)) for x in found])

        return ids

    return scorer(make, "array<int>")
