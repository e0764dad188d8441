"""Places for models: a plug-in is made once in each worker process and sees batches of values, never single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Make = Callable[[], Callable[[Sequence], Sequence]]


def batched(make: Make, returns: str, *columns: Column) -> Column:
    """The plug-in's answer for each row. make loads the model; it runs once for each task's iterator."""

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = make()
        for batch in batches:
            yield pd.Series(list(answer(batch.tolist())), dtype=object)

    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        answer = make()
        for batch in batches:
            yield pd.Series(list(answer(list(zip(*[b.tolist() for b in batch], strict=True)))), dtype=object)

    from pyspark.sql.pandas.functions import PandasUDFType

    kind = PandasUDFType.SCALAR_ITER
    return F.pandas_udf(one if len(columns) == 1 else many, returns, kind)(*columns)


def identified(make: Make, text: Column) -> Column:
    """Language labels."""
    return batched(make, "string", text)


@dataclass(frozen=True)
class Identifier:
    """A language identifier with what a result must state about it: its name, its revision and the labels it can give."""

    name: str
    revision: str
    labels: frozenset[str]
    make: Make

    def label(self, text: Column) -> Column:
        """The label of each text, null where it gives none; a label outside its set fails the job."""
        found = identified(self.make, text)
        message = F.concat(F.lit(f"{self.name} {self.revision} gave a label it does not state: "), found)
        return F.when(found.isNull() | found.isin(*sorted(self.labels)), found).otherwise(F.raise_error(message).cast("string"))

    def covers(self, language: str) -> bool:
        """Whether it could give the language at all: else a score of it says nothing."""
        return language in self.labels


def encoded(make: Make, text: Column) -> Column:
    """Token ids."""
    return batched(make, "array<int>", text)


def counted(make: Make, text: Column) -> Column:
    return batched(make, "int", text)


def tagged(make: Make, tokens: Column) -> Column:
    """A label or null for each token; the answer must have the length of its input."""
    labels = batched(make, "array<string>", tokens)
    return F.when(F.size(labels) == F.size(tokens), labels).otherwise(F.raise_error(F.lit("a tagger's answer has another length than its input")).cast("array<string>"))


def agreement(make: Make, a: Column, b: Column) -> Column:
    """A score of two strings."""
    return batched(make, "double", a, b)


def of_language(rows: DataFrame, make: Make, text: str, language: str) -> DataFrame:
    """Rows whose identified language is the claimed one."""
    return rows.where(identified(make, F.col(text)) == language)


def with_reasons(rows: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    """rows with the reason for which a table excludes them, or null."""
    return rows.join(reasons.select(key, "reason"), key, "left")
