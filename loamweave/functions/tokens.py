"""Token counters: how many tokens a text has, and by which counter, so figures of different counters are never mixed."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Counter:
    identity: str
    count: Callable[[str], int]

    def __call__(self, text: str) -> int:
        return self.count(text)

    def column(self, text: Column) -> Column:
        """Counts of a column, batch by batch; null for null."""
        count = self.count

        @F.pandas_udf("long")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else count(t)).astype("Int64")

        return run(text)


DEFAULT = Counter("characters-div-4", lambda text: max(1, len(text) // 4))


def vocabulary(path: str, name: str) -> Counter:
    """Counter of a byte vocabulary file (base64 piece and rank a line); nothing is cut off, special marks count as text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in lines if line.strip()}
    encoding = tiktoken.Encoding(name, pat_str=r"""\s?\p{L}+|\s?\p{N}+|\s?[^\s\p{L}\p{N}]+|\s+""", mergeable_ranks=ranks, special_tokens={})
    return Counter(name, lambda text: len(encoding.encode(text, disallowed_special=())))
