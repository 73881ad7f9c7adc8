"""Token counts of whole texts, by rank-synchronous array merging.

Null texts count as empty: 0 bytes, 0 tokens. Bytes that aren't UTF-8 count as they are, their tokens as those of U+FFFD. Repeated rows get a row each; columns other than the id
and the text are passed over, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytewords as bw
from tessera.llm import wordbpe


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit). `tokenizer` is the file's path on every executor."""
    frame = documents.select(F.col(id_column), F.col(text_column).alias("text"))
    kind = frame.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(tokenizer)
        for batch in batches:
            texts = bw.texts(batch.column(1))
            n = np.zeros(len(texts), np.int64)
            for lo, hi in wordbpe.token_groups(texts):
                n[lo:hi] = bpe.count_batch(texts[lo:hi])
            size = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], [id_column, "n_bytes", "n_tokens", "over_limit"])

    return bw.arrow(frame, run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
