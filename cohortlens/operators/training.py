"""From a labelled panel to train and test sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.features import class_targets
from cohortlens.operators.panel import month_split, months_in
from cohortlens.operators.sampling import undersample

# Derived columns that are never features.
TARGETS = ["clase_peso", "clase_binaria1", "clase_binaria2"]


@dataclass(frozen=True)
class TrainingSets:
    train: DataFrame
    test: DataFrame
    features: list[str]


def training_sets(
    df: DataFrame,
    id_col: str,
    period: str,
    label: str,
    train: list[int],
    test: list[int],
    fraction: float = 1.0,
    seed: int = 42,
    drop: list[str] = (),
    drop_unlabelled: bool = False,
) -> TrainingSets:
    """Scan the months, add weight and targets, thin out the customers who stay, split by month.

    The id, the period, the label and the targets stay in the frames but are not features.
    A month to be scored has no labels; `drop_unlabelled` removes such rows from training only.
    """
    rows = class_targets(months_in(df, period, [*train, *test]), label)
    rows = undersample(rows, id_col, period, label, fraction, seed)
    features = [
        c for c in rows.columns if c not in {id_col, period, label, *TARGETS, *drop}
    ]
    kept = rows.select(id_col, period, label, *TARGETS, *features)
    train_rows, test_rows = month_split(kept, period, train, test)
    if drop_unlabelled:
        train_rows = train_rows.where(F.col(label).isNotNull())
    return TrainingSets(train_rows, test_rows, features)
