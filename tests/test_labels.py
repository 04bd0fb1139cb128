"""A panel kept up month by month against labelling all of it again."""

import random

import pytest

from cohortlens.operators.panel import churn_label
from cohortlens.sources import labels


@pytest.mark.parametrize("calendar", [False, True])
def test_every_prefix_equals_a_full_relabel(spark, tmp_path, calendar):
    rng, months, root = random.Random(1), [202101, 202102, 202104, 202105], str(tmp_path / "t")
    rows = [(i, m, float(i)) for m in months for i in range(30) if rng.random() < 0.6] + [(3, 202102, 9.0)]
    df = spark.createDataFrame(rows, "id long, period int, x double")
    key = lambda r: (r["period"], r["id"], r["x"])
    for n, m in enumerate(months, 1):
        written = labels.add_month(df.where(f"period = {m}"), root, "id", "period", calendar=calendar)
        assert written == months[max(0, n - 3) : n]
        want = churn_label(df.where(f"period <= {m}"), "id", "period", calendar=calendar).collect()
        got = labels.current(spark, root, "period").collect()
        assert sorted(((*key(r), r["label"] or "") for r in got)) == sorted(((*key(r), r["label"] or "") for r in want))
    some = labels.current(spark, root, "period", [202102])
    assert {r["period"] for r in some.collect()} == {202102}
    with pytest.raises(ValueError):
        labels.add_month(df.where("period = 202104"), root, "id", "period")
    assert labels.add_month(df.limit(0), root, "id", "period") == []


def test_an_arrival_that_broke_off_does_not_count(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(i, m) for m in (1, 2, 3) for i in range(m, 6)], "id long, period int")
    labels.start(df.where("period < 3"), root, "id", "period")
    before = sorted(map(tuple, labels.current(spark, root, "period").collect()), key=str)
    with monkeypatch.context() as patch:
        patch.setattr(spark.__class__, "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            labels.add_month(df.where("period = 3"), root, "id", "period")
    assert sorted(map(tuple, labels.current(spark, root, "period").collect()), key=str) == before
    assert labels.add_month(df.where("period = 3"), root, "id", "period") == [1, 2, 3]
    want = sorted(map(tuple, churn_label(df, "id", "period").select("id", "label", "period").collect()), key=str)
    assert sorted(map(tuple, labels.current(spark, root, "period").select("id", "label", "period").collect()), key=str) == want
