"""Running a Python function over the texts of a table, batch by batch.

``map_texts`` is the one bridge between Spark and the Python operators: it
narrows the input to an identifier and a text under private names (so that
extra or clashing columns of the caller cannot interfere), streams Arrow
batches, and hands the function plain lists.

Batches are bounded by bytes as well as by rows: ``stream`` sets Spark's own
limit for Arrow batches in the session, unless a lower one is set there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch are handed on in groups of at most this many characters, so
#: that a batch of long texts needs no more memory than one of short texts.
GROUP_CHARS = 500_000
#: Bytes of an Arrow batch; a single longer row stands alone.
BATCH_BYTES = 4_000_000
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def stream(frame: DataFrame, run: Callable, ddl: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES``."""
    conf = frame.sparkSession.conf
    held = conf.get(_LIMIT).removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(_LIMIT, str(BATCH_BYTES))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        # The worker process lives on; what it has freed goes back to the system.
        pa.default_memory_pool().release_unused()

    return frame.mapInArrow(released, ddl)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and text (null becomes empty) under the names ``doc_id`` and ``text``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def free(name: str, df: DataFrame) -> str:
    """``name``, with as many lines below it as make it none of the columns of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def groups(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows holding about ``limit`` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def map_texts(frame: DataFrame, schema: str, arrow_schema: pa.Schema, start: Callable[[], Callable], text_col: str = "text") -> DataFrame:
    """Apply a function of (other columns as lists, texts) to all rows of ``frame``.

    ``start`` runs once in each task and returns the function; the function
    returns the output columns, in the order of ``arrow_schema``.
    """
    others = [c for c in frame.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            rest = [batch.column(c).to_pylist() for c in others]
            for a, b in groups(texts):
                columns = work([c[a:b] for c in rest], texts[a:b])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

    return stream(frame, run, schema)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it; a group may reach over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
