"""Search over parameters: grids, the score of a task, and the choice of the best."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: What is tried (fixed values).
WINDOWS = (8, 10, 12)
WEIGHTS = (0.3, 0.5, 0.8, 1.0)
#: The score that chooses, by task (fixed values).
SCORE = {"CLASS": "f1", "CLUST": "adjusted_mutual_information", "RANK": "rouge_1_recall", "RANK_CORR": "pearson"}


def grid(**values: Iterable) -> list[dict]:
    """All combinations, the last name varying fastest."""
    return [dict(zip(values, row)) for row in itertools.product(*values.values())]


@dataclass
class Search:
    """Scores parameters in turn; ``best`` is the first of the highest. Earlier choices can be fixed for later searches."""

    score: Callable[..., float]
    fixed: dict = field(default_factory=dict)
    tried: list[tuple[dict, float]] = field(default_factory=list)

    def run(self, rows: list[dict]) -> dict:
        for row in rows:
            self.tried.append((row, float(self.score(**self.fixed, **row))))
        return self.best

    @property
    def best(self) -> dict:
        return max(self.tried, key=lambda t: t[1])[0]

    def then(self, score: Callable[..., float] | None = None) -> Search:
        """A search that keeps what this one chose."""
        return Search(score or self.score, self.fixed | self.best)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(", ".join(f"{k}={v}" for k, v in (self.fixed | row).items()), s) for row, s in self.tried], "parameters string, score double")
