"""The gain metric for Spark ML's own tuning classes."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.profit import gain_max
from cohortlens.session import stored


class GainEvaluator(Evaluator):
    """Highest cumulative gain over descending probability; larger is better.

    Pass it to CrossValidator (with foldCol) or TrainValidationSplit.
    """

    def __init__(self, id_col: str, gain_col: str, probability_col: str = "probability"):
        super().__init__()
        self.id_col = id_col
        self.gain_col = gain_col
        self.probability_col = probability_col

    def _evaluate(self, dataset: DataFrame) -> float:
        scores = dataset.select(
            self.id_col,
            self.gain_col,
            vector_to_array(F.col(self.probability_col)).getItem(1).alias("_score"),
        )
        best = gain_max(stored(scores, "scores"), "_score", self.id_col, self.gain_col)
        return float(best.first()["gain_max"] or 0)

    def isLargerBetter(self) -> bool:
        return True
