"""Shared helpers: splits by id, words as hashes, whole texts in bounded pieces of work."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import stored

# Bytes of text that one step of a task handles at once; a longer text is a step of its own.
STEP_BYTES = 4 << 20

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
# Two odd multipliers of the splitmix64 finaliser.
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# ASCII letters and digits stay (in lower case), other ASCII becomes a space, UTF-8 of the rest stays.
WORD_BYTES = bytes(
    ASCII_LOWER[c] if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. Null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def held_out(doc_id: str | Column, n: int, r: int) -> Column:
    """Rows kept from training. A row without an id cannot be assigned and is never learned from."""
    return F.coalesce(remainder(doc_id, n) == r, F.lit(True))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, most: int, by_class: bool = False, doc_id: str = "doc_id"
) -> DataFrame:
    """The rows of `docs` with a label, at most `most` labels (of each class): those of the smallest id hashes.

    The chosen labels are few by their bound, so they are broadcast and the texts are not shuffled. The
    result is a written table, read several times by a fit. Null ids and null labels are left out.
    """
    named = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, label)
    order = F.xxhash64(F.col(doc_id), F.lit(label))
    if by_class:
        parts = [named.where(F.col(label) > 0), named.where(F.col(label) <= 0)]
        chosen = parts[0].orderBy(order).limit(most).unionByName(parts[1].orderBy(order).limit(most))
    else:
        chosen = named.orderBy(order).limit(most)
    return stored(docs.join(F.broadcast(chosen), doc_id).select(*docs.columns, label), "labelled")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX_A
        x = (x ^ (x >> U64(27))) * MIX_B
        return x ^ (x >> U64(31))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case (A-Z) words of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-case (A-Z) words between ASCII white space."""
    return text.translate(ASCII_LOWER).split()


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct hashes of runs of `width` words; a shorter text is one run, an empty one has none."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        s = np.full(n, width, U64)
        for j in range(width):
            s = s * GOLDEN + h[j : j + n]
    return np.unique(mix(s))


def steps(lengths: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(lengths) > start:
        yield start, len(lengths)


def text_steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Texts (null: empty) as UTF-8, in lists of about `most` bytes, with the first row's number."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    lengths = np.nan_to_num(
        pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)
    )
    for a, b in steps(lengths, most):
        yield a, [t or b"" for t in column.slice(a, b - a).to_pylist()]


# Delete the shuffle files of an execution when it ends, not when the driver collects its garbage.
CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of frames made within this go when their action ends; for frames that are computed once."""
    before = spark.conf.get(CLEAN_CONF, "false")
    spark.conf.set(CLEAN_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_CONF, before)


_SHIPPED: set[str] = set()
# Rows of an Arrow batch: they hold whole texts, and Spark's 10,000 of them are large on both sides.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they can import it anywhere.

    Arrow batches become smaller, unless the session has its own size for them.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="cohortlens-")) / "cohortlens.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for f in sorted(root.rglob("*.py")):
            archive.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def arrow_map(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """`mapInArrow` whose workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
