"""Quality rules by robust outliers: texts far from the bulk of their language and source.

Every text becomes a vector of statistics, transformed so that the bulk is round: the logarithm of the mean word
length, and square roots of the shares of symbols, of repeated lines, of words in repeated three-word windows, of
capitals and of other punctuation. The bulk of a group (language and source; language; everything) has the centre and
scatter of least determinant over subsets of three quarters of its rows. They are found by concentration steps over
all rows, from two beginnings (means and covariances; medians and absolute deviations): each step measures every row's
distance, counts rows and sums moments by classes of distance, and takes the nearest classes that hold the three quarters.
One step is one aggregation, combined before it is shuffled, whatever the size of a group. A text is rejected if its
squared Mahalanobis distance is beyond the cut-off of its most specific group that has enough rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import arrow_map, fresh, text_steps
from cohortlens.session import join_on, pin, stored

# The least scale of each coordinate: many texts have no symbols and no repetitions at all, and where the bulk
# does not vary the scatter would have no inverse.
SCALES = {"word_length": 0.05, "symbols": 0.06, "same_lines": 0.12, "same_words": 0.12, "capitals": 0.05, "signs": 0.05}
DIMS = len(SCALES)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
# Added to the denominators: one repeated line is a small share of a short text, too.
FEW_LINES, FEW_WORDS = 5, 50
# The share of a group whose scatter is least, the fewest rows of a group, the most concentration steps.
SUBSET = 0.75
FEWEST = 20 * DIMS
STEPS = 10
# Chance of a normal vector beyond the cut-off. Real rates have longer tails than normal ones.
BEYOND = 3e-5
# Classes of squared distance: so many for a factor of two, between these powers of two.
CLASSES, LOW, HIGH = 16, -20, 30
# Classes of a coordinate, for medians.
GRID = 512
# The limits of the base rule.
FEWEST_WORDS, REPEATED_PERCENT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_signs")
KEYS = ["_level", "_lang", "_source"]
MODEL = "_level int, _lang string, _source string, rows long, centre array<double>, precision array<double>"


def _normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return low


def chi_square_quantile(p: float, k: int) -> float:
    """By the cube-root approximation of Wilson and Hilferty."""
    return k * (1 - 2 / (9 * k) + _normal_quantile(p) * math.sqrt(2 / (9 * k))) ** 3


def _chi_square_chance(x: float, k: int) -> float:
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(-z / math.sqrt(2))


# The nearest three quarters of normal rows vary less than all of them, by this factor.
CONSISTENCY = SUBSET / _chi_square_chance(chi_square_quantile(SUBSET, DIMS), DIMS + 2)
CUTOFF = DIMS * (1 - 2 / (9 * DIMS) - _normal_quantile(BEYOND) * math.sqrt(2 / (9 * DIMS))) ** 3

# One flag for each kind of byte: begins a character in a word, symbol, capital, other ASCII punctuation.
_SPACE = set(b" \t\n\x0b\x0c\r")
_SYMBOLS = set(b"#*$%&|<>")
CHAR, SYMBOL, CAPITAL, SIGN = (
    np.array([f(c) for c in range(256)], np.int64)
    for f in (
        lambda c: c not in _SPACE and not 0x80 <= c < 0xC0,
        lambda c: c in _SYMBOLS,
        lambda c: 65 <= c <= 90,
        lambda c: 33 <= c < 127 and not chr(c).isalnum() and c not in _SYMBOLS,
    )
)


def _repeated(split: list[list[bytes]]) -> np.ndarray:
    """Of each list of words, how many stand in a three-word window that the list has twice or more."""
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for words in split for w in words), np.int64, starts[-1])
    owner = np.repeat(np.arange(len(split)), sizes)
    out = np.zeros(len(split), np.int64)
    if len(ids) < 3:
        return out
    first = np.flatnonzero(owner[:-2] == owner[2:])
    if not len(first):
        return out
    # Windows as numbers without collisions: pairs are numbered first, then pair and third word.
    _, pair = np.unique(ids[first] * len(known) + ids[first + 1], return_inverse=True)
    _, window = np.unique(pair * len(known) + ids[first + 2], return_inverse=True)
    order = np.lexsort((owner[first], window))
    w, o = window[order], owner[first][order]
    same = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = first[order[twice]]
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[at + k] = True
    np.add.at(out, owner[hit], 1)
    return out


def _counts(texts: list[bytes]) -> np.ndarray:
    """COUNTS of every text."""
    split = [t.split() for t in texts]
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    out[:, 0] = [len(w) for w in split]
    for i, t in enumerate(texts):
        of = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        out[i, 1], out[i, 2], out[i, 6], out[i, 7] = of @ CHAR, of @ SYMBOL, of @ CAPITAL, of @ SIGN
        out[i, 3], out[i, 5] = len(lines) - len(set(lines)), len(lines)
    out[:, 4] = _repeated(split)
    return out


def measure(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """All rows and columns of `docs`, and a struct `name` of counts over the whole text.

    n_words (between ASCII white space), word_chars (code points in them), n_symbols (`#*$%&|<>`), n_dup_lines (lines
    with a word that equal an earlier one), n_repeat_words (words in three-word windows that the text has twice or
    more), n_lines (with a word), n_capitals (A-Z), n_signs (other ASCII punctuation). A null text is empty: all zero.
    """
    kind = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    work = fresh(docs, "measured_text")

    def run(batches):
        for batch in batches:
            for at, texts in text_steps(batch.column(batch.num_columns - 1)):
                found = _counts(texts)
                made = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))
                out = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*out.columns[:-1], made], names=[*out.schema.names[:-1], name])

    return arrow_map(docs.withColumn(work, F.col(text)), run, schema)


def coordinates(statistics: str = "statistics") -> list[Column]:
    """The transformed statistics of a text with words."""
    c = lambda n: F.col(f"{statistics}.{n}").cast("double")
    share = lambda a, b, few=0: F.sqrt(c(a) / F.greatest(c(b) + F.lit(float(few)), F.lit(1.0)))
    return [
        F.log(c("word_chars") / F.greatest(c("n_words"), F.lit(1.0))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines", FEW_LINES),
        share("n_repeat_words", "n_words", FEW_WORDS),
        share("n_capitals", "word_chars"),
        share("n_signs", "word_chars"),
    ]


def _distance(x: list[Column], centre: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance; `precision` is the upper triangle of the inverse scatter."""
    apart = [a - F.get(centre, F.lit(i)) for i, a in enumerate(x)]
    terms = [
        F.get(precision, F.lit(k)) * apart[i] * apart[j] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)
    ]
    return reduce(lambda a, b: a + b, terms)


def _scatter(covariance: np.ndarray) -> tuple[list[float], float]:
    """Upper triangle of the inverse, and the logarithm of the determinant, of a scatter with least scales."""
    full = covariance + np.diag(np.square(list(SCALES.values())))
    inverse = np.linalg.inv(full)
    return [float(inverse[i, j]) for i, j in PAIRS], float(np.linalg.slogdet(full)[1])


_FITTED = f"{MODEL}, start int, taken long, size double"
_NUMBERS = pa.list_(pa.float64())
_FITTED_ARROW = pa.schema(
    [("_level", pa.int32()), ("_lang", pa.string()), ("_source", pa.string()), ("rows", pa.int64()), ("centre", _NUMBERS),
     ("precision", _NUMBERS), ("start", pa.int32()), ("taken", pa.int64()), ("size", pa.float64())]
)


def _concentrated(batches):
    """The nearest classes of each group that hold the wanted share: centre, inverse scatter, determinant."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            classes = sorted(r["classes"], key=lambda c: c["at"])
            rows = sum(c["n"] for c in classes)
            wanted = rows if r["whole"] else math.ceil(SUBSET * rows)
            n, sums = 0, np.zeros(DIMS + len(PAIRS))
            for c in classes:
                if n >= wanted:
                    break
                n, sums = n + c["n"], sums + np.array(c["sums"])
            centre = sums[:DIMS] / n
            spread = np.zeros((DIMS, DIMS))
            for (i, j), s in zip(PAIRS, sums[DIMS:]):
                spread[i, j] = spread[j, i] = s / n - centre[i] * centre[j]
            precision, size = _scatter(spread * (1.0 if r["whole"] else CONSISTENCY))
            out.append(
                {**{k: r[k] for k in KEYS}, "rows": rows, "centre": centre.tolist(), "precision": precision,
                 "start": r["start"], "taken": n, "size": size}
            )
        if out:
            yield pa.RecordBatch.from_pylist(out, _FITTED_ARROW)


def _medians(batches):
    """Medians and absolute deviations of each group, from counts by classes of every coordinate."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            centre, scale, rows = np.zeros(DIMS), np.zeros(DIMS), 0
            for d in range(DIMS):
                own = [c for c in r["classes"] if c["dim"] == d]
                value = np.array([c["at"] for c in own], float) / GRID
                n = np.array([c["n"] for c in own], float)
                rows = int(n.sum())

                def middle(v, n=n):
                    order = np.argsort(v, kind="stable")
                    return v[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]

                centre[d] = middle(value)
                scale[d] = 1.4826 * middle(np.abs(value - centre[d]))
            precision, size = _scatter(np.diag(np.square(scale)))
            out.append(
                {**{k: r[k] for k in KEYS}, "rows": rows, "centre": centre.tolist(), "precision": precision,
                 "start": 1, "taken": 0, "size": size}
            )
        if out:
            yield pa.RecordBatch.from_pylist(out, _FITTED_ARROW)


def _step(rows: DataFrame, at: Column, start: Column, whole: bool) -> DataFrame:
    """New centres and scatters from rows with classes of distance `at`."""
    names = [f"_x{i}" for i in range(DIMS)]
    sums = [F.sum(c) for c in names] + [F.sum(F.col(names[i]) * F.col(names[j])) for i, j in PAIRS]
    classes = rows.withColumns({"start": start, "at": at}).groupBy(*KEYS, "start", "at").agg(
        F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums")
    )
    # At most (HIGH - LOW) * CLASSES + 1 classes for a group and a beginning.
    per_group = classes.groupBy(*KEYS, "start").agg(
        F.collect_list(F.struct("at", "n", "sums")).alias("classes"), F.lit(whole).alias("whole")
    )
    return pin(arrow_map(per_group, _concentrated, _FITTED), row_bytes=400)


def fit(measured: DataFrame, lang: str = "lang", source: str = "source", statistics: str = "statistics") -> DataFrame:
    """Centre and inverse scatter of every language and source with enough rows, of its language, of everything.

    All texts with words take part. Groups of fewer than FEWEST rows are left to their language, languages
    to everything; a table with fewer has an empty model. Null languages and sources are groups like others.
    """
    x = coordinates(statistics)
    flat = measured.where(F.col(f"{statistics}.n_words") > 0).select(
        F.col(lang).cast("string").alias("_l"), F.col(source).cast("string").alias("_s"),
        *[c.alias(f"_x{i}") for i, c in enumerate(x)],
    )
    none = F.lit(None).cast("string")
    # Which groups have enough rows, and which languages and whether everything are wanted for the others.
    counted = pin(flat.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("n")))
    spoken = pin(counted.groupBy("_l").agg(F.sum("n").alias("n"), F.min("n").alias("least")))
    small = counted.where(F.col("n") < FEWEST).limit(1).count() > 0
    flat = stored(flat, "statistics")
    keyed = [join_on(flat, counted.where(F.col("n") >= FEWEST).select("_l", "_s"), ["_l", "_s"], "left_semi").withColumns(
        {"_level": F.lit(1), "_lang": F.col("_l"), "_source": F.col("_s")}
    )]
    if small:
        enough = spoken.where((F.col("n") >= FEWEST) & (F.col("least") < FEWEST)).select("_l")
        keyed.append(
            join_on(flat, enough, ["_l"], "left_semi").withColumns(
                {"_level": F.lit(2), "_lang": F.col("_l"), "_source": none}
            )
        )
        if spoken.agg(F.min("n"), F.sum("n")).where((F.col("min(n)") < FEWEST) & (F.col("sum(n)") >= FEWEST)).count():
            keyed.append(flat.withColumns({"_level": F.lit(3), "_lang": none, "_source": none}))
    rows = reduce(DataFrame.unionByName, keyed).drop("_l", "_s")

    grid = rows.select(
        *KEYS, F.posexplode(F.array(*[F.floor(F.col(f"_x{i}") * GRID) for i in range(DIMS)])).alias("dim", "at")
    )
    grid = grid.groupBy(*KEYS, "dim", "at").agg(F.count(F.lit(1)).alias("n"))
    grid = grid.groupBy(*KEYS).agg(F.collect_list(F.struct("dim", "at", "n")).alias("classes"))
    begin = arrow_map(grid, _medians, _FITTED).unionByName(_step(rows, F.lit(0), F.lit(0), True))
    found = pin(begin, row_bytes=400)
    columns = [F.col(f"_x{i}") for i in range(DIMS)]
    squared = F.greatest(_distance(columns, F.col("_of.centre"), F.col("_of.precision")), F.lit(2.0**LOW))
    at = F.floor(F.least(F.log2(squared), F.lit(float(HIGH))) * CLASSES)
    before = None
    for _ in range(STEPS):
        both = found.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "centre", "precision")).alias("_both"))
        measured_rows = join_on(rows, pin(both, row_bytes=800), KEYS).withColumn("_of", F.explode("_both"))
        found = _step(measured_rows, at, F.col("_of.start"), False)
        state = found.agg(F.sum("taken").alias("t"), F.sum(F.round("size", 9)).alias("s")).first()
        if before is not None and abs((state["s"] or 0) - (before["s"] or 0)) < 1e-9 and state["t"] == before["t"]:
            break
        before = state
    best = found.groupBy(*KEYS).agg(F.min_by(F.struct("rows", "centre", "precision"), F.struct("size", "start")).alias("b"))
    return pin(best.select(*KEYS, "b.*"), row_bytes=400)


def judge(
    measured: DataFrame, model: DataFrame, lang: str = "lang", source: str = "source", statistics: str = "statistics",
    name: str = "rules",
) -> DataFrame:
    """All rows and columns of `measured`, and a struct `name`: base_failed, level, distance, kept.

    `base_failed`: fewer than 50 words, or more than half of them in repeated windows. `level`: the group
    measured against (1: language and source, 2: language, 3: everything). `distance`: squared Mahalanobis distance,
    null without words or without a group. `kept`: not base_failed, and no distance beyond CUTOFF.
    """
    x = coordinates(statistics)
    work = fresh(measured, "_fit")
    out = measured.withColumns({f"{work}_l": F.col(lang).cast("string"), f"{work}_s": F.col(source).cast("string")})
    own = F.struct(F.col("_level").alias("level"), "centre", "precision")
    for level, keys in ((1, {"_lang": f"{work}_l", "_source": f"{work}_s"}), (2, {"_lang": f"{work}_l"})):
        some = model.where(F.col("_level") == level).select(
            *[F.col(k).alias(v) for k, v in keys.items()], own.alias(f"{work}{level}")
        )
        out = join_on(out, pin(some, row_bytes=400), list(keys.values()), "left")
    rest = pin(model.where(F.col("_level") == 3).select(own.alias(f"{work}3")), row_bytes=400)
    out = out.join(rest, F.lit(True), "left")  # one row at most
    out = out.withColumn(work, F.coalesce(*[F.col(f"{work}{i}") for i in (1, 2, 3)]))
    words, twice = F.col(f"{statistics}.n_words"), F.col(f"{statistics}.n_repeat_words")
    distance = F.when(words > 0, _distance(x, F.col(f"{work}.centre"), F.col(f"{work}.precision")))
    out = out.withColumns(
        {
            f"{work}_d": distance,
            f"{work}_b": (words < FEWEST_WORDS) | (100 * twice > REPEATED_PERCENT * words),
        }
    )
    far = F.coalesce(F.col(f"{work}_d") > CUTOFF, F.lit(False))
    rules = F.struct(
        F.col(f"{work}_b").alias("base_failed"),
        F.when(words > 0, F.col(f"{work}.level")).alias("level"),
        F.col(f"{work}_d").alias("distance"),
        (~F.col(f"{work}_b") & ~far).alias("kept"),
    )
    return out.select(*measured.columns, rules.alias(name))
