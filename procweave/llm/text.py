"""What several corpus operators share: columns, word splitting, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words and is stripped from lines: space and U+0009 to U+000D.
SPACE = " \t\n\u000b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step takes at a time.
SLICE_BYTES = 1 << 20


def words_of(text: Column) -> Column:
    """The words of a text; none for null, empty or blank texts."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.octet_length(bare) > 0, F.split(bare, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the documents that nothing may learn from: crc32 of the id as text, mod folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows of about `limit` bytes in a column, at least a row each.

    A single text may be longer than the limit; it is then alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
