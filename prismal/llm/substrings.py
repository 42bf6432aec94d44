"""Substring dedup by recompression.

Words are named by 64-bit hashes, and rounds of recompression name longer and
longer pieces of every text: a short run of one symbol becomes one symbol, and
so does a pair whose left symbol falls in one half of the alphabet and whose
right symbol falls in the other. A name is a hash of what it names, so that
all executors agree on it without a dictionary, and which symbols merge
depends on the symbols alone. Hence equal passages are parsed equally but for
their ends: a boundary between two symbols of the last round depends on the
CONTEXT words to either side of it, and symbols have at most REACH words. Any
`window` words (35 by default) hold a boundary whose whole context lies within
them; the one with the smallest name stands for the window.

1. Each document gives one row a boundary that stands for some of its windows
   (about one row for 10 words): the name of the symbols around it.
2. Names that occur once in the whole corpus are out: their windows can't
   repeat. The count has a partial sum before the shuffle.
3. The other boundaries' spans, all windows that one stands for, are named by
   a hash of all their words. Where a span occurs twice, all its windows
   repeat. What copies share is settled here, in one row for many windows.
4. Where a boundary's name has several different spans, one of each is taken
   apart: its windows are named by a hash of 96 bits over all their words and
   counted. Windows that a span shares with another one go.

Rows are keyed by names, never gathered: a passage that is in a third of all
documents makes many rows in one partition of a join, which Spark splits, but
no group. The text is shuffled once by document, compressed, and that exchange
serves the verification and the removal.

Windows are judged on the input. Words keep their spelling; a window lies in
one document. Null and empty texts have no words; texts shorter than a window
lose none; rows that repeat an id and text are documents of their own, and
repeat each other; rows that share an id with other texts are told apart; an
empty table gives no rows. A very long text is one row of an Arrow batch. Only
the columns that are named are read, so that others can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import STEP, keyed, mixed, shown_id, steps, token_table, word_hashes
from prismal.session import ship

WINDOW = 35
#: Words to either side on which a boundary depends, and the most words of a symbol. Round 1 merges runs of 2 words
#: (a boundary depends on 2 words to either side) and then pairs of up to 4 words (2 more); round 2 merges pairs of up to 8 words (4 more).
CONTEXT, REACH = 8, 8

_SALT = np.random.default_rng(7).integers(0, 2**63, (4, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(2**64 - 1)

_PACKED = "_id bigint, _th int, _z binary"
#: A range of windows travels as one number: the first one, and how many more, below SPAN.
SPAN = 64
_BOUNDARIES = "_name bigint, _id bigint, _th int, _range bigint"
_SPANS = "_name bigint, _span bigint, _id bigint, _th int, _range bigint"
_WINDOWS = "_wa bigint, _wb int, _open boolean, _id bigint, _th int, _at int"
_RESULT = "_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _merged_pairs(name: np.ndarray, begin: np.ndarray, length: np.ndarray, doc: np.ndarray, most: int, salt: int) -> tuple[np.ndarray, ...]:
    """One pair step: a left symbol of class 0 and a right one of class 1 become one symbol of up to `most` words."""
    half = (mixed(name ^ _SALT[0, salt]) >> np.uint64(63)).astype(bool)
    pair = ~half[:-1] & half[1:] & (doc[:-1] == doc[1:]) & (length[:-1] + length[1:] <= most)
    left = np.flatnonzero(pair)
    name, length = name.copy(), length.copy()
    name[left] = mixed(name[left] * _SALT[1, salt] + name[left + 1])
    length[left] += length[left + 1]
    keep = np.ones(len(name), bool)
    keep[left + 1] = False
    return name[keep], begin[keep], length[keep], doc[keep]


def boundaries(token: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where a symbol of the last round begins."""
    out = np.zeros(len(token), bool)
    if not len(token):
        return out
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(token)))
    # Runs of 2 become a symbol; longer ones stay single words, so that no symbol outgrows the window.
    short = run <= 2
    begin = np.flatnonzero(~np.repeat(short, run) | new)
    owner = np.searchsorted(start, begin, side="right") - 1
    length = np.where(short[owner], run[owner], 1)
    name = np.where(length > 1, mixed(token[begin] + length.astype(np.uint64) * _SALT[2, 0]), token[begin])
    name, begin, length, doc = _merged_pairs(name, begin, length, doc[begin], 4, 1)
    name, begin, length, doc = _merged_pairs(name, begin, length, doc, REACH, 2)
    out[begin] = True
    return out


def _hashes(token: np.ndarray, at: np.ndarray, length: int, row: int) -> np.ndarray:
    """A hash of the words token[at : at + length]."""
    h = np.full(len(at), length, np.uint64)
    for k in range(length):
        x = token[at + k] ^ _SALT[row, k]
        h += (x ^ (x >> np.uint64(29))) * _SALT[(row + 1) % 4, k]
    return mixed(h)


def stands(token: np.ndarray, doc: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(name, document, first window, last window) of each boundary that stands for windows, window starts being places in `token`."""
    n = len(token)
    none = np.zeros(0, np.int64)
    if n < window:
        return np.zeros(0, np.uint64), none, none, none
    place = np.flatnonzero(boundaries(token, doc))
    place = place[(place >= CONTEXT) & (place <= n - CONTEXT)]
    place = place[doc[place - CONTEXT] == doc[np.minimum(place + CONTEXT, n) - 1]]
    best = np.full(n + window, _LAST)
    best[place] = np.minimum(_hashes(token, place - CONTEXT, 2 * CONTEXT, 0), _LAST - np.uint64(1))
    where = np.arange(n + window)
    width, wanted = 1, window - 2 * CONTEXT + 1
    while width < wanted:  # the leftmost smallest name among ever more places
        step = min(width, wanted - width)
        right = best[step:] < best[:-step]
        where = np.where(right, where[step:], where[:-step])
        best = np.where(right, best[step:], best[:-step])
        width += step
    starts = np.arange(n - window + 1)
    starts = starts[doc[starts] == doc[starts + window - 1]]
    stand, name = where[starts + CONTEXT], best[starts + CONTEXT]
    if (name == _LAST).any():
        raise AssertionError("a window without a boundary")
    new = np.ones(len(starts), bool)
    new[1:] = stand[1:] != stand[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return name[first], doc[starts[first]], starts[first], starts[last]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets, word, distinct = token_table(texts)
    token = word_hashes(distinct)[word] if len(word) else np.zeros(0, np.uint64)
    return offsets, token, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _name_boundaries(window: int):
    def run(batches):
        for whole in batches:
            for batch in steps(whole):
                offsets, token, doc = _tokens(_column(batch, "_text"))
                name, owner, lo, hi = stands(token, doc, offsets, window)
                base = offsets[owner]
                owner_index = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), _column(batch, "_id").take(owner_index), _column(batch, "_th").take(owner_index), pa.array((lo - base) * SPAN + hi - lo)], names=["_name", "_id", "_th", "_range"])

    return run


def _ranges(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of a column of lists of structs."""
    rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    both = lists.flatten().field("_range").to_numpy(zero_copy_only=False).astype(np.int64)
    return rows, both // SPAN, both // SPAN + both % SPAN


def _expanded(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, place) for every place in begin..end, both included."""
    size = end - begin + 1
    owner = np.repeat(np.arange(len(size)), size)
    before = np.cumsum(size) - size
    return owner, begin[owner] + np.arange(len(owner)) - before[owner]


def _pack():
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=5).compress
        for batch in batches:
            packed = [squeeze(t.as_buffer()) for t in _column(batch, "_text")]
            yield pa.RecordBatch.from_arrays([_column(batch, "_id"), _column(batch, "_th"), pa.array(packed, pa.binary())], names=["_id", "_th", "_z"])

    return run


def _unpacked(batches):
    """Batches with the text in place of its packed form, in steps of bounded size."""
    widen = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        at = batch.schema.get_field_index("_z")
        packed = batch.column(at)
        start, texts, held = 0, [], 0
        for i in range(batch.num_rows):
            texts.append(widen(packed[i].as_py()))
            held += len(texts[-1])
            if held > 6 * STEP or i + 1 == batch.num_rows:
                yield batch.slice(start, len(texts)).set_column(at, "_text", pa.array(texts, pa.binary()).cast(pa.string()))
                start, texts, held = i + 1, [], 0


def _flat(lists: pa.Array, field: str) -> np.ndarray:
    return lists.flatten().field(field).to_numpy(zero_copy_only=False)


def _name_spans(window: int):
    def run(batches):
        for batch in _unpacked(batches):
            offsets, token, _ = _tokens(_column(batch, "_text"))
            spans = _column(batch, "_spans")
            row, lo, hi = _ranges(spans)
            name, begin, length = _flat(spans, "_name"), lo + offsets[row], hi - lo + window
            span = np.zeros(len(row), np.uint64)
            for n in np.unique(length):  # as many as a boundary can stand for
                same = np.flatnonzero(length == n)
                span[same] = _hashes(token, begin[same], int(n), 1)
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(span.view(np.int64)), _column(batch, "_id").take(index), _column(batch, "_th").take(index), pa.array(lo * SPAN + hi - lo)], names=["_name", "_span", "_id", "_th", "_range"])

    return run


def _name_windows(window: int):
    def run(batches):
        for batch in _unpacked(batches):
            offsets, token, _ = _tokens(_column(batch, "_text"))
            spans = _column(batch, "_spans")
            row, lo, hi = _ranges(spans)
            alone = _flat(spans, "_open").astype(bool)
            owner, at = _expanded(lo + offsets[row], hi + offsets[row])
            doc = row[owner]
            index = pa.array(doc)
            wa, wb = _hashes(token, at, window, 2), _hashes(token, at, window, 3) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([pa.array(wa.view(np.int64)), pa.array(wb.astype(np.int32)), pa.array(alone[owner]), _column(batch, "_id").take(index), _column(batch, "_th").take(index), pa.array((at - offsets[doc]).astype(np.int32))], names=["_wa", "_wb", "_open", "_id", "_th", "_at"])

    return run


def _remove(window: int, keep_text: bool):
    def run(batches):
        for whole in batches:
            for batch in _unpacked([whole]):
                offsets, word, distinct = token_table(_column(batch, "_text"))
                row, lo, hi = _ranges(_column(batch, "_spans"))
                edge = np.zeros(len(word) + 1, np.int64)
                np.add.at(edge, lo + offsets[row], 1)
                np.add.at(edge, hi + offsets[row] + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                total = np.zeros(len(word) + 1, np.int64)
                np.cumsum(~gone, out=total[1:])
                left = pa.ListArray.from_arrays(pa.array(total[offsets].astype(np.int32)), distinct.take(pa.array(word[~gone])).cast(pa.string()))
                text = pc.binary_join(left, " ")
                n, kept = np.diff(offsets), np.diff(total[offsets])
                columns = [_column(batch, "_id"), pa.array(n), pa.array(n - kept)]
                if keep_text:
                    columns.append(text)
                else:
                    columns.append(pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in text], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_words", "n_removed", "kept" if keep_text else "kept_sha256"])

    return run


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return a.join(b.withColumnsRenamed({c: f"{c}r" for c in on}), [F.col(c) == F.col(f"{c}r") for c in on], how).drop(*(f"{c}r" for c in on))


def deduplicated(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and kept (the words left, joined by one blank) or its kept_sha256."""
    if not 2 * CONTEXT + REACH <= window < 2 * CONTEXT + SPAN:
        raise ValueError(f"a window has {2 * CONTEXT + REACH} to {2 * CONTEXT + SPAN - 1} words")
    ship(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    packed = texts.mapInArrow(_pack(), _PACKED)
    boundary = texts.mapInArrow(_name_boundaries(window), _BOUNDARIES)
    again = boundary.groupBy("_name").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_name")
    live = boundary.join(again, "_name", "left_semi").groupBy("_id", "_th").agg(F.collect_set(F.struct("_name", "_range")).alias("_spans"))
    # Rows that share id and text are joined to the same spans, and each gives its own.
    spans = _joined(packed, live, ["_id", "_th"]).mapInArrow(_name_spans(window), _SPANS)
    kinds = spans.groupBy("_name", "_span").agg(F.count(F.lit(1)).alias("_k"), F.min(F.struct("_id", "_th", "_range")).alias("_one"))
    settled = spans.join(kinds.where("_k > 1").select("_name", "_span"), ["_name", "_span"], "left_semi").select("_id", "_th", "_range")
    several = kinds.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_name")
    apart = kinds.join(several, "_name", "left_semi").select("_one.*", (F.col("_k") == 1).alias("_open"))
    apart = apart.groupBy("_id", "_th").agg(F.collect_set(F.struct("_range", "_open")).alias("_spans"))
    # Rows that share id and text count their windows once each, but none of their spans is open then: they repeat each other.
    windows = _joined(packed, apart, ["_id", "_th"]).mapInArrow(_name_windows(window), _WINDOWS)
    twice = windows.groupBy("_wa", "_wb").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_wa", "_wb")
    shared = windows.where("_open").join(twice, ["_wa", "_wb"], "left_semi").select("_id", "_th", (F.col("_at").cast("long") * SPAN).alias("_range"))
    gone = settled.unionByName(shared).groupBy("_id", "_th").agg(F.collect_set(F.struct("_range")).alias("_spans"))
    schema = _RESULT.replace("kept_sha256", "kept") if keep_text else _RESULT
    return _joined(packed, gone, ["_id", "_th"], "left").select("_id", "_z", "_spans").mapInArrow(_remove(window, keep_text), schema).withColumn("_id", shown_id(F.col("_id"))).withColumnRenamed("_id", "doc_id")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
