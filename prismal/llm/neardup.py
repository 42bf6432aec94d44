"""MinHash near-dedup with min-max hashing.

Each document's set of distinct word shingles is signed under `permutations`
hash permutations; both the smallest and the largest value under each one are
kept, so that half as many evaluations give a signature of 2 * permutations
values. The signature is cut into bands; documents that agree on a band are
candidates, and every link is confirmed on the full sets. At the threshold the
chance that a pair shares no band is (1 - s ** rows) ** bands: 7e-9 for the
default of 32 bands of 5 at 0.85, and smaller above.

Candidates are confirmed in a fixed number of rounds, so that large groups of
copies and large groups of texts that are merely alike cost no pairs of all
their members:

1. Documents with equal sets are one class, found by a 128-bit digest, and only
   one of a class takes part in the search. The others join it at the end.
2. Each class is compared with the smallest class of each of its bands. A band
   of two, or one whose members these links connect, is done with.
3. The classes of the bands that are left list their shingles from the rarest
   to the commonest among them. Two sets that are alike enough share one of the
   first n - ceil(t * n) + 1 of their n, and from their first common one on there
   must be enough left on both sides for the overlap that the threshold asks
   for. Texts of a group that have more words of their own than the threshold
   allows therefore meet nobody, however large the group is.
   a) Of those with a common shingle in these heads, each is compared with the
      one that has the smallest share of shingles of its own.
   b) What is still in different components is compared if the places allow it.
   No link between different components can be missed.

Components are found by a fixed point of joins with tables in the shared
folder, each deleted when the next one stands. Nothing but counts of rows comes
to the driver.

Null texts and texts without words have an empty set: they are linked with
nothing. Texts of fewer than `width` words have their whole sequence as their
one shingle. A very long text is one row of an Arrow batch and one array of its
shingles; nothing is cut. Rows that share a doc_id are one document, linked by
what any of them links, though each row counts its own shingles. Null doc_ids
are returned as they are, with no component and kept. Ties need no rule, for
every comparison is an exact count; an empty table gives no rows. Only the two
columns that are named are read, so that others can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.llm.common import NO_ID, mixed, shown_id, steps, token_table, word_hashes
from prismal.session import forget, ship, stored

WIDTH = 3
PERCENT = 85
BANDS, ROWS = 32, 5

_SIGNED = "_id bigint, _th bigint, _n bigint, _d1 bigint, _d2 bigint, _bands array<bigint>"
_SETS = "_k bigint, _set array<bigint>"


def _lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, by bytes: no other character of UTF-8 holds such a byte."""
    import pyarrow.compute as pc

    return pc.ascii_lower(pc.fill_null(texts, ""))


def shingle_sets(texts: pa.Array, width: int):
    """(set sizes, all sets' 64-bit shingles end to end, sorted within each)."""
    offsets, word, distinct = token_table(_lowered(texts))
    token = word_hashes(distinct)[word] if len(word) else np.zeros(0, np.uint64)
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = np.diff(offsets)
    grams = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), grams)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(grams, out=first[1:])
    at = offsets[:-1][doc] + (np.arange(len(doc)) - first[:-1][doc])
    length = np.minimum(n[doc], width)
    h = length.astype(np.uint64)
    for k in range(width):
        inside = length > k
        part = np.zeros(len(doc), np.uint64)
        part[inside] = mixed(token[at[inside] + k] * odd[k])
        h = mixed(h * odd[k] + part)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return np.bincount(doc, minlength=len(n)), h


def signatures(sizes: np.ndarray, grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[documents with a set, bands] keys from the min and max under bands * rows / 2 permutations."""
    has = sizes[sizes > 0]
    starts = np.zeros(len(has), np.int64)
    np.cumsum(has[:-1], out=starts[1:])
    rng = np.random.default_rng(85)
    count = (bands * rows + 1) // 2
    keys = rng.integers(0, 2**63, (count, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values = np.empty((2 * count, len(has)), np.uint64)
    if len(has):
        for k, (a, b) in enumerate(keys):
            x = grams * a + b
            x ^= x >> np.uint64(32)
            x *= M3
            values[2 * k] = np.minimum.reduceat(x, starts)
            values[2 * k + 1] = np.maximum.reduceat(x, starts)
    out = np.empty((len(has), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(has), band + 1, np.uint64)
        for row in range(rows):
            h = mixed(h * M3 + values[band * rows + row])
        out[:, band] = h
    return out


M3 = np.uint64(0x9E3779B97F4A7C15)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sign(width: int, bands: int, rows: int):
    def run(batches):
        for whole in batches:
            for batch in steps(whole):
                sizes, grams = shingle_sets(batch.column(2), width)
                has = np.flatnonzero(sizes)
                keys = signatures(sizes, grams, bands, rows)
                d = np.zeros((2, len(sizes)), np.uint64)
                if len(has):
                    starts = np.zeros(len(has), np.int64)
                    np.cumsum(sizes[has][:-1], out=starts[1:])
                    d[0, has] = np.add.reduceat(mixed(grams + M3), starts)
                    d[1, has] = np.add.reduceat(mixed(mixed(grams) * M3 + np.uint64(7)), starts)
                per_doc = np.where(sizes > 0, bands, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), _lists(per_doc, keys.ravel())], names=["_id", "_th", "_n", "_d1", "_d2", "_bands"])

    return run


def _shingle(width: int):
    def run(batches):
        for whole in batches:
            for batch in steps(whole):
                sizes, grams = shingle_sets(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sizes, grams)], names=["_k", "_set"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    x = pairs.join(sets.select(F.col("_k").alias("b"), F.col("_set").alias("_sb")), "b")
    x = x.join(sets.select(F.col("_k").alias("a"), F.col("_set").alias("_sa")), "a")
    x = x.withColumn("_both", F.size(F.array_intersect("_sa", "_sb")))
    return x.where(100 * F.col("_both") >= percent * (F.size("_sa") + F.size("_sb") - F.col("_both"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(_k, _c), stored: the smallest key that each end of edges(a, b) reaches, for all but the smallest ones themselves.

    Alternates large stars and small stars, which halves what is left of every
    path and keeps as many edges as there are nodes at most; ends when a round changes nothing.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        last, edges = edges, stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        forget(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    out = edges.select(F.col("u").alias("_k"), F.col("v").alias("_c"))
    out._stored_at = edges._stored_at
    return out


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """components() of what is found and more links."""
    return components(links.unionByName(found.select(F.col("_c").alias("a"), F.col("_k").alias("b"))))


def _in_component(x: DataFrame, found: DataFrame) -> DataFrame:
    return x.join(found, "_k", "left").withColumn("_c", F.coalesce("_c", "_k"))


def _fits(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m shingles whose first common one is at places i and j can be alike enough."""
    return F.least(n - i, m - j) * (100 + percent) >= percent * (n + m)


def _heads(sets: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """(_w, _k, _n, _i, _own): the shingles at the head of each set of `left` that others of them have, their places, the set's share of shingles of its own."""
    each = sets.join(left, "_k", "left_semi").select("_k", F.size("_set").cast("long").alias("_n"), F.explode("_set").alias("_w"))
    counts = each.groupBy("_w").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    of_set = Window.partitionBy("_k")
    own = F.col("_n") - F.count(F.lit(1)).over(of_set)
    x = each.join(counts, "_w").withColumn("_alone", own).withColumn("_i", F.col("_alone") + F.row_number().over(of_set.orderBy("_df", "_w")) - 1)
    return x.where(100 * (F.col("_n") - F.col("_i")) >= percent * F.col("_n")).select("_w", "_k", "_n", "_i", (F.col("_alone") / F.col("_n")).alias("_own"))


def _with_hubs(heads: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each set with the one of its shingle's sets that has the least of its own."""
    x = _in_component(heads, found)
    hubs = x.groupBy("_w").agg(F.min(F.struct("_own", "_k", "_n", "_i", "_c")).alias("_hub"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo <> _hi").select("_w", "_hub")
    x = x.join(hubs, "_w").where((F.col("_c") != F.col("_hub._c")) & _fits(F.col("_n"), F.col("_i"), F.col("_hub._n"), F.col("_hub._i"), percent))
    return x.select(F.least("_k", "_hub._k").alias("a"), F.greatest("_k", "_hub._k").alias("b")).distinct()


def _across(heads: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components with a common shingle at places that fit. A shingle's largest component isn't compared with itself."""
    x = _in_component(heads, found)
    each = x.groupBy("_w", "_c").agg(F.count(F.lit(1)).alias("_m"), F.min("_n").alias("_least"))
    groups = each.groupBy("_w").agg(F.max(F.struct("_m", "_c")).alias("_top"), F.min("_least").alias("_least"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1").select("_w", "_least", F.col("_top._c").alias("_most"))
    # A set whose place allows only partners smaller than all of the group's has none.
    x = x.join(groups, "_w").where((F.col("_n") - F.col("_i")) * (100 + percent) >= percent * (F.col("_n") + F.col("_least")))
    one = x.where("_c <> _most").select("_w", F.col("_k").alias("a"), F.col("_n").alias("_na"), F.col("_i").alias("_ia"), F.col("_c").alias("_ca"))
    other = x.select("_w", F.col("_k").alias("b"), F.col("_n").alias("_nb"), F.col("_i").alias("_ib"), F.col("_c").alias("_cb"), "_most")
    met = one.join(other, "_w").where((F.col("_ca") != F.col("_cb")) & ((F.col("a") < F.col("b")) | (F.col("_cb") == F.col("_most"))) & _fits(F.col("_na"), F.col("_ia"), F.col("_nb"), F.col("_ib"), percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    ship(docs.sparkSession)
    signed = stored(texts.mapInArrow(_sign(width, bands, rows), _SIGNED), "signed")
    known = signed.where((F.col("_n") > 0) & (F.col("_id") != NO_ID))
    class_of = ["_n", "_d1", "_d2"]
    classes = known.groupBy(*class_of).agg(F.min(F.struct("_id", "_th", "_bands")).alias("_r"))
    classes = stored(classes.select(*class_of, "_r.*").withColumn("_k", F.monotonically_increasing_id()), "classes")
    of_row = known.select("_id", *class_of).join(classes.select(F.col("_k"), F.col("_id").alias("_first"), *class_of), class_of)

    # Bands with two classes or more; a row a member.
    spread = classes.select("_k", F.explode("_bands").alias("_key"))
    shared = spread.groupBy("_key").agg(F.count(F.lit(1)).alias("_m"), F.min("_k").alias("_low")).where("_m > 1")
    members = stored(spread.join(shared, "_key"), "members")
    wanted = classes.join(members.select("_k").distinct(), "_k", "left_semi").select("_k", "_id", "_th")
    sets = stored(texts.join(wanted, ["_id", "_th"]).select("_k", "_text").mapInArrow(_shingle(width), _SETS).dropDuplicates(["_k"]), "sets")

    # A document whose rows have different sets ties the classes of all of them together.
    torn = of_row.groupBy("_id").agg(F.min("_k").alias("a"), F.max("_k").alias("_z")).where("a <> _z").select("_id", "a")
    ties = of_row.join(torn, "_id").select("a", F.col("_k").alias("b"))

    stars = members.where("_k <> _low").select(F.col("_low").alias("a"), F.col("_k").alias("b")).distinct()
    found = components(_confirmed(stars, sets, percent).unionByName(ties))
    x = _in_component(members.where("_m > 2"), found)
    opened = x.groupBy("_key").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo <> _hi").select("_key")
    left = x.join(opened, "_key", "left_semi").select("_k").distinct()
    heads = stored(_heads(sets, left, percent), "heads")
    for compared in (_with_hubs, _across):
        last, found = found, _joined(found, _confirmed(compared(heads, found, percent), sets, percent))
        forget(last)
    forget(members, sets, heads)

    inside = found.unionByName(found.select(F.col("_c").alias("_k"), "_c").distinct())
    lows = inside.join(classes.select("_k", "_id"), "_k").groupBy("_c").agg(F.min("_id").alias("_label"))
    labels = stored(inside.join(lows, "_c").select("_k", "_label"), "labels")
    forget(found)
    named = classes.join(labels, "_k", "left").select(*class_of, F.coalesce("_label", "_id").alias("_c"))
    rows_ = signed.select("_id", *class_of).join(named.withColumnsRenamed({c: f"{c}r" for c in class_of}), [F.col(c) == F.col(f"{c}r") for c in class_of], "left")
    return _answers(rows_)


def _answers(x: DataFrame) -> DataFrame:
    component = F.when(F.col("_id") != NO_ID, F.coalesce("_c", "_id"))
    kept: Column = F.coalesce(F.col("_id") == component, F.lit(True))
    return x.select(shown_id(F.col("_id")).alias("doc_id"), F.col("_n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
