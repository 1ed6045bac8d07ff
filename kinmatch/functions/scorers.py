"""String scores as columns, from 0 to 100.

Arguments are SQL expressions.  The kernel-backed scores are Arrow UDFs: a batch of pairs goes through the
vectorised kernel at once.  A null on either side gives null and costs nothing,
so callers pass null where a score is not needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text
from .kernel import pair_scores, partial_scores, weighted_scores


def _batch_scores(left: pd.Series, right: pd.Series, score) -> pd.Series:
    result = np.full(len(left), np.nan)  # NaN leaves as null
    given = (left.notna() & right.notna()).to_numpy()
    if given.any():
        result[given] = score(left[given].tolist(), right[given].tolist())
    return pd.Series(result)


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return _batch_scores(left, right, lambda a, b: pair_scores(a, b, tokens=False))


@F.pandas_udf(DoubleType())
def _token_set(left: pd.Series, right: pd.Series) -> pd.Series:
    return _batch_scores(left, right, lambda a, b: pair_scores(a, b, tokens=True))


@F.pandas_udf(DoubleType())
def _partial(left: pd.Series, right: pd.Series) -> pd.Series:
    return _batch_scores(left, right, partial_scores)


@F.pandas_udf(DoubleType())
def _weighted(left: pd.Series, right: pd.Series) -> pd.Series:
    return _batch_scores(left, right, weighted_scores)


def ratio(a: str, b: str) -> Column:
    """Normalised indel similarity: 100 · 2·LCS / (len a + len b); two empty strings give 100."""
    return _ratio(F.expr(a), F.expr(b))


def token_set_ratio(a: str, b: str) -> Column:
    """Similarity of the distinct token sets; 0 if either side has no token."""
    return _token_set(F.expr(text.token_key(a)), F.expr(text.token_key(b)))


def token_sort_ratio(a: str, b: str) -> Column:
    """Ratio of the sorted tokens."""
    return _ratio(F.expr(text.sorted_tokens(a)), F.expr(text.sorted_tokens(b)))


def partial_ratio(a: str, b: str) -> Column:
    """Best ratio of the shorter string against any window of the longer one."""
    return _partial(F.expr(a), F.expr(b))


def weighted_ratio(a: str, b: str) -> Column:
    """Weighted maximum of the other scores, chosen by how much the lengths differ."""
    return _weighted(F.expr(a), F.expr(b))
