"""Questions that documents ask of the whole corpus, by packed shuffles.

Documents are dealt to buckets of about the same amount of text. A bucket sends its distinct hashes, packed by part, to
the tasks that own the parts; those see all buckets' hashes and send answers back, packed by bucket. A frequent hash is
thus sent once a bucket and never gathers a group of rows. Tasks hold one bucket or one part, whose sizes don't grow
with the corpus; there are more of them instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_CHARS = 4_000_000
PART_CHARS = 8_000_000


def bucketed(docs: DataFrame, keep: list[str] | None = None, bucket_chars: int = BUCKET_CHARS) -> tuple[DataFrame, int]:
    """(bucket, doc_id, text, *keep) of all rows, dealt by bucket, and a number of parts. Null texts become empty.

    One number, the corpus's length, comes to the driver. The deal is by a hash of id and text, so that neither null
    nor repeated ids gather, and it is the same whenever it is computed again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(keep or []))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(chars / bucket_chars) + 1
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("bucket"), *rows.columns), math.ceil(chars / PART_CHARS) + 1


def split_by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the hashes by part, then value, and the bounds of the parts in it (parts + 1)."""
    part = (hashes >> np.uint64(32)) % np.uint64(parts)
    order = np.lexsort((hashes, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def texts(table: pa.Table) -> Iterator[bytes]:
    """The texts of a bucket as UTF-8."""
    for chunk in table.column("text").cast(pa.large_binary()).chunks:
        for value in chunk:
            yield value.as_py()
