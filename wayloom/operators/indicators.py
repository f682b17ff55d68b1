"""Text columns as indicators for linear models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame


def indicators(columns: Sequence[str], train: DataFrame) -> list:
    """Stages that turn text columns into 0/1 indicators (`_o_` columns), the first level in the alphabet left out.

    Levels are those of `train`; a level that it lacks has no indicator, like the one left out. So the matrix has full rank
    beside an intercept."""
    columns = list(columns)
    levels = StringIndexer(inputCols=columns, outputCols=[f"_i_{c}" for c in columns], handleInvalid="keep", stringOrderType="alphabetDesc").fit(train)
    last = [max(0, len(names) - 1) for names in levels.labelsArray]
    known = SQLTransformer(statement="SELECT *, " + ", ".join(f"least(`_i_{c}`, {n}D) AS `_j_{c}`" for c, n in zip(columns, last)) + " FROM __THIS__")
    encoder = OneHotEncoder(inputCols=[f"_j_{c}" for c in columns], outputCols=[f"_o_{c}" for c in columns], dropLast=True)
    return [levels, known, encoder]
