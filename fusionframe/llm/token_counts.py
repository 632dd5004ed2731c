"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at single spaces between two other characters. There the word mark of the
next piece begins, and the vocabulary is checked to hold no piece with a mark inside, so the
counts of the parts add up to the count of the whole. Parts are encoded in batches of about
equal bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, table

PART_CHARS = 4096
_SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.get_piece_size()))
    whole = m.encode("a  b") == m.encode(" a  b")[1:] or m.encode("a b") == m.encode("a") + m.encode("b")
    return m, not inner and whole


def safe_parts(text: str, limit: int = PART_CHARS) -> list[str]:
    """Parts of at least `limit` characters (but the last) whose token counts add up; joined by one space they are the text."""
    if len(text) <= limit:
        return [text]
    parts, at = [], 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit - 1)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.end()
    return [*parts, text[at:]]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 18) -> DataFrame:
    """id, n_bytes long, n_tokens long, one row per input row.

    Null and empty texts have no bytes and no tokens; very long texts are encoded in parts;
    repeated rows are counted again; a null id stays null; no rows give no rows; other columns
    are ignored. `model_path` has to be readable on every executor.
    """

    def rows(batch: pa.RecordBatch):
        model, splits = _model(model_path)
        for a, b in byte_slices(batch.column(1), batch_bytes):
            texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
            parts, owner = [], []
            for i, x in enumerate(texts):
                own = safe_parts(x) if splits else [x]
                parts += own
                owner += [i] * len(own)
            counts = [0] * len(texts)
            for i, ids in zip(owner, model.encode(parts, num_threads=1), strict=True):
                counts[i] += len(ids)
            yield {id_col: batch.column(0).slice(a, b - a), "n_bytes": [len(x.encode()) for x in texts], "n_tokens": counts}

    kind = docs.schema[id_col].dataType
    types = pa.schema([(id_col, pa.int64() if kind.simpleString() == "bigint" else pa.string()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    out = docs.select(F.col(id_col) if kind.simpleString() == "bigint" else F.col(id_col).cast("string"), text_col)
    return arrow_map(out, rows, f"`{id_col}` {'bigint' if kind.simpleString() == 'bigint' else 'string'}, n_bytes bigint, n_tokens bigint", types)


def op5_token_counts(spark, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
