"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .prefix_bpe import PATTERN, PrefixEncoder, read_ranks

#: Largest rank file that is broadcast, in bytes; public vocabularies are far below it.
MOST_BYTES = 64 << 20
#: Rows whose texts and ids are Python objects at a time.
ROWS = 512


def encode(documents: DataFrame, identity: str, text: str, rank_file: str, pattern: str = PATTERN) -> DataFrame:
    """``identity, ids``: the ids of each row's whole text by the vocabulary of ``rank_file``, without special tokens.

    Null and empty texts give an empty list. Every row gives one row, repeated ones too; strings of special
    tokens in a text are ordinary text. Nothing is shuffled: the vocabulary (of fixed, checked size) is broadcast, and a
    worker remembers the encodings of the pieces that it has met, up to a bound.
    """
    data = Path(rank_file).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{rank_file} is larger than {MOST_BYTES} bytes")
    shared = documents.sparkSession.sparkContext.broadcast({"ranks": data})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # one object for all tasks of a worker, which so keeps what it has learned
        if "encoder" not in held:
            held["encoder"] = PrefixEncoder(read_ranks(held["ranks"]), pattern)
        encoder = held["encoder"]
        split, pieces = encoder.split, encoder.pieces
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            flat, ends = [], [0]
            for one in batch.column(1).to_pylist():
                if one:
                    for ids in map(pieces.__getitem__, split(one)):
                        flat += ids
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [identity, "ids"])

    kind = documents.schema[identity].dataType.simpleString()
    return documents.select(identity, text).mapInArrow(run, f"`{identity}` {kind}, ids array<int>")
