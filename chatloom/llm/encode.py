"""Problem 7: encoding of the corpus with a public tokenizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .bpe import TOKENIZERS


def encode_column(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """``array<int>`` of token ids of a text, without special tokens.

    Null and empty texts give an empty array; strings that look like special tokens are ordinary text; texts of any
    length are encoded whole. Ids travel back as one flat buffer for each Arrow batch.
    """
    import numpy as np
    import pyarrow as pa

    def run(texts: pa.Array) -> pa.Array:
        from .bpe import tokenizer

        packed = tokenizer(name, folder).packed
        rows = [packed(t) for t in texts.to_pylist()]
        ends = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(IntegerType()))(text)


def count_column(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """``bigint`` number of tokens of a text; 0 for null and empty texts."""
    import pyarrow as pa

    def run(texts: pa.Array) -> pa.Array:
        from .bpe import tokenizer

        packed = tokenizer(name, folder).packed
        return pa.array([len(packed(t)) // 4 for t in texts.to_pylist()], pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, LongType())(text)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``id_col, ids`` of every row; a scan and a projection, no shuffle. Rows with equal ids stay apart."""
    return docs.select(F.col(id_col), encode_column(F.col(text_col), name, folder).alias("ids"))
