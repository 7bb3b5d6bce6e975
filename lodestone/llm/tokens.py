"""Token counts, and encoding with decoding, by the tables of :mod:`.bpe`.

Each task keeps a table of the distinct chunks it met (bounded; it is emptied when full)
and segments a chunk once, however often and in however many texts it occurs.  Ids and
decoded bytes are then joined back by position.  Tables are per task and not one for the
corpus: the number of distinct chunks grows with the corpus, so a common table would
have to be shuffled against every occurrence of every word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkTable, pieces
from .common import tidy
from .words import batches, column


def _select(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit``, as the library counts, without begin or end ids.

    docs: a long id and a text; other columns are ignored, rows may repeat and ids may be
    null.  Null and empty texts have no bytes and no tokens.  over_limit: n_tokens > limit.
    """

    def run(it):
        table = ChunkTable(pieces(model), len)
        for batch in batches(it):
            texts = batch.column("text").to_pylist()
            chunked = [table.model.chunks(t) for t in texts]
            table.add(chunked)
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array(np.diff(column(batch.column("text"))[1]), pa.int64()),
                    pa.array([sum(map(table.__getitem__, c)) for c in chunked], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    found = _select(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def encode_decode(
    docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", contents: bool = False
) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``contents`` also ``ids`` and ``decoded``.

    ids_sha256: of the decimal ids joined by commas; decoded_sha256: of the UTF-8 of what
    the library's decode(ids) returns.  Null and empty texts have no ids and decode to
    nothing.  Other columns are ignored, rows may repeat and ids may be null.
    """

    def run(it):
        model_ = pieces(model)

        def entry(ids):
            return len(ids), ",".join(map(str, ids)).encode(), b"".join(map(model_.bytes_of.__getitem__, ids))

        table = ChunkTable(model_, entry)
        for batch in batches(it):
            chunked = [model_.chunks(t) for t in batch.column("text").to_pylist()]
            table.add(chunked)
            rows = []
            for chunks in chunked:
                parts = [table[c] for c in chunks]
                ids = b",".join([p[1] for p in parts])
                decoded = b"".join([p[2] for p in parts])
                decoded = decoded[1:] if decoded[:1] == b" " else decoded  # the dummy prefix
                rows.append(
                    (sum([p[0] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    + ((([int(i) for i in ids.split(b",")] if ids else []), decoded.decode("utf-8", "replace")) if contents else ())
                )
            kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * contents
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * contents
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.record_batch([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * contents
    return _select(docs, id_col, text_col).mapInArrow(tidy(run), schema)
