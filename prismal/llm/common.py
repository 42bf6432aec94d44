"""Shared pieces of the training-data operators: words, document keys, scratch tables.

A word is a maximal run of characters other than space, tab, line feed,
vertical tab, form feed and carriage return. Both the SQL form (`words`)
and the Arrow form (`token_table`) follow that definition exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Stands in for a null document id inside join keys; results show null again.
NO_ID = -(2**63)


def words(text: Column) -> Column:
    """Array of words; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_tag(text: Column) -> Column:
    """32 bits that tell apart the texts of rows that share an id."""
    return F.hash(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, _text): the id never null, and a hash that tells apart rows sharing an id."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        text_tag(F.col(text_col)).alias("_th"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )


def shown_id(col: Column) -> Column:
    return F.when(col != F.lit(NO_ID), col)


def packed(df: DataFrame) -> Column:
    """All columns of `df` in one struct, so that an operator's own columns clash with none of them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def unpacked(row: str, columns: list[str], own: dict[str, Column]) -> list[Column]:
    """`columns` out of the struct `row`, those named like a result being replaced by it in their place, and the other results behind."""
    return [own[c].alias(c) if c in own else F.col(row)[c].alias(c) for c in columns] + [v.alias(k) for k, v in own.items() if k not in columns]


# --- Arrow side -------------------------------------------------------------

#: Tokens that one vectorised step handles at most, but for a single longer document.
STEP = 400_000
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


def token_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets by document, word index by token, distinct words)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(lengths)), out=offsets[1:])
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def steps(batch: pa.RecordBatch, text_col: str = "_text"):
    """Slices of a batch that hold about STEP tokens' worth of text each."""
    size = pc.binary_length(pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > STEP * 6:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
