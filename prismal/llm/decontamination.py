"""Benchmark decontamination by template canonicalisation (DataFrame operations only).

A text becomes a sequence of words in which numbers, units of measure and
names (capitalised words inside a sentence) are typed placeholders, and all
else is lower case without punctuation. Every window of `window` canonical
words of every document is looked up among those of the benchmark by hash.
A hit counts when the words agree and the slots are consistent: where the
benchmark repeats a value, the document must repeat its own, and where it has
different values the document must too. So a question with other numbers and
names is caught, and a sentence that merely has numbers in the same places is
not. A window needs `min_literal` words that are not placeholders.

Both sides are read in two ways, and a window is found if it is in either. In
the strict reading a name is a capitalised word inside a sentence. In the loose
one every capitalised word is a name, also at the start of a sentence or a
line, behind a quotation mark and with a possessive, and number words are
numbers. In both, a number joined to its unit ("12kg") is two slots and a range
("12-15") one. Names of the loose reading alone still count as literal words
for `min_literal`.

All documents are scanned once, in the loose reading. So that this scan finds
what either reading does, the benchmark's windows are looked up by several
keys: in both readings, and with each single word as a name, for a document may
begin a sentence where the benchmark doesn't. Documents with a hit are then
compared word by word in both readings.

An item is found in a document when `enough` of its windows are, or at least
`share` of them, in one reading. Items shorter than a window are looked up as
a whole. Items without a window of `min_literal` literal words are found where
the document has their exact sequence of lower-cased words; one of a single
word, where that is the whole document.

The keys of the benchmark's windows are written to the shared folder and counted:
up to BROADCAST_KEYS of them (8 bytes each) are broadcast, so that only hits
leave the scan of the documents; more are joined by hash.

Null and empty texts match nothing, nor does an empty table; a null doc_id is
returned with its own verdict; repeated rows get equal verdicts; an item on the
very limit of `enough` or `share` is found; an empty benchmark clears all. A
very long text is one array of its words. Only the columns that are named are
read, so that others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import SPACE, WORD, keyed, shown_id, words
from prismal.session import stored

WINDOW = 6
MIN_LITERAL = 4
SHARE = 0.2
ENOUGH = 8

#: Keys of the benchmark that are broadcast at most, 16 MB or so.
BROADCAST_KEYS = 1_000_000

NUMBER, UNIT, NAME = "①", "②", "③"
#: Before a word that is a name by the loose reading alone.
LOOSE = "④"
READINGS = (False, True)
#: Units of measure as they follow a number, and number words.
UNITS = "km|m|cm|mm|mi|mile|miles|ft|foot|feet|inch|inches|yd|yard|yards|kg|g|mg|lb|lbs|oz|ton|tons|l|ml|litre|litres|liter|liters|gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hr|hrs|hour|hours|day|days|week|weeks|month|months|year|years|kmh|mph|usd|eur|dollar|dollars|euro|euros|cent|cents|percent"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()


#: Punctuation and symbols; the placeholders are neither.
MARKS = r"[\p{P}\p{S}]+"


def spaced(text: Column) -> Column:
    """The text whose words are read: numbers are parted from their units."""
    joined = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}])([0-9][0-9.,]*)(?=(?i:{UNITS})(?![\p{{L}}\p{{N}}]))", "$1 ")
    return F.when(text.rlike("[0-9][A-Za-z]"), joined).otherwise(text)


def canonical_text(text: Column, mark: str) -> Column:
    """The spaced text with typed placeholders, LOOSE before names of the loose reading, lower case otherwise, each run of punctuation turned into `mark`; white space stays as it is."""
    blank, end = r"[\x20\x09-\x0D]", r"(?=[^\p{L}\p{N}\x20\x09-\x0D]*(?:[\x20\x09-\x0D]|$))"
    x = F.regexp_replace(text, rf"{blank}(?<=[^\x20\x09-\x0D.!?:].)\p{{Lu}}[\p{{Ll}}\p{{M}}]*{end}", f" {NAME}")
    x = F.regexp_replace(x, rf"(\p{{Lu}}(?<![\p{{L}}\p{{N}}\p{{M}}/’–-].)[\p{{Ll}}\p{{M}}]*+(?:['’]s)?){end}", f"{LOOSE}$1")
    x = F.lower(x)
    numbered = F.regexp_replace(x, rf"(^|{blank})[^\p{{L}}\p{{N}}{NUMBER}{UNIT}{NAME}{LOOSE}\x20\x09-\x0D]*[0-9][0-9.,:/–-]*{end}", f"$1{NUMBER}")
    measured = F.regexp_replace(numbered, rf"{NUMBER}[^\p{{L}}\p{{N}}\x20\x09-\x0D]*({blank})(?:{UNITS}){end}", f"{NUMBER}$1{UNIT}")
    x = F.when(text.rlike("[0-9]"), measured).otherwise(x)
    return F.regexp_replace(x, MARKS, mark)


def canonical_words(text: Column) -> Column:
    """The canonical words; those of punctuation alone are left out."""
    return F.filter(F.split(canonical_text(spaced(text), ""), SPACE), lambda c: c != "")


def canonical(text: Column) -> Column:
    """The same words as structs (c, v): canonical and as written."""
    read = spaced(text)
    found = F.regexp_extract_all(canonical_text(read, "\u2400"), F.lit(WORD), F.lit(0))
    pairs = F.arrays_zip(found.alias("c"), words(read).alias("v"))
    stripped = F.transform(pairs, lambda p: F.struct(F.translate(p["c"], "\u2400", "").alias("c"), F.lower(p["v"]).alias("v")))
    return F.filter(stripped, lambda p: p["c"] != "")


def _is_number_word(c: Column) -> Column:
    return c.isin(NUMBER_WORDS)


def read_as(seq: Column, loose: bool) -> Column:
    """The canonical words in one reading."""
    if not loose:
        return F.transform(seq, lambda c: F.when(c.startswith(LOOSE), F.substring(c, 2, 1 << 30)).otherwise(c))
    units = UNITS.split("|")

    def one(c: Column, i: Column) -> Column:
        measures = c.isin(units) & (i > 0) & _is_number_word(F.coalesce(F.get(seq, i - 1), F.lit("")))
        return F.when(c.startswith(LOOSE), F.lit(NAME)).when(_is_number_word(c), F.lit(NUMBER)).when(measures, F.lit(UNIT)).otherwise(c)

    return F.transform(seq, one)


def plain_words(text: Column) -> Column:
    """The lower-cased words without punctuation, nothing replaced."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{Nd}\x20\x09-\x0D]+", ""), F.lit(WORD), F.lit(0))


def _read(seq: Column, loose: bool) -> Column:
    """The array of canonical() in one reading."""
    return F.zip_with(read_as(seq["c"], loose), seq["v"], lambda c, v: F.struct(c.alias("c"), v.alias("v")))


def _is_slot(c: Column) -> Column:
    return c.isin(NUMBER, UNIT, NAME)


def _slots(window: Column) -> Column:
    """For each slot of a window, the place of the first slot with its value."""
    values = F.transform(F.filter(window, lambda p: _is_slot(p["c"])), lambda p: F.regexp_replace(p["v"], r"^[^\p{L}\p{N}]+|(?:['’]s)?[^\p{L}\p{N}]*$", ""))
    return F.get(F.transform(F.array(values), lambda vs: F.transform(vs, lambda v: F.array_position(vs, v))), F.lit(0))


def _hashed(i: Column, length: int) -> Column:
    """The key of `length` words from place i on, given the words' hashes in _h."""
    return F.xxhash64(*(F.get("_h", i + k) for k in range(length)))


def _entry(n: int):
    return lambda i: F.struct(F.lit(n).alias("_len"), i.alias("_at"), _hashed(i, n).alias("_key"))


def _keys(lengths: list[int]) -> Column:
    """The keys of all windows of the hashes in _h."""
    none = F.array().cast("array<bigint>")

    def key(n: int):
        return lambda h, i: F.xxhash64(h, *(F.get("_h", i + k) for k in range(1, n)))

    each = [F.when(F.size("_h") >= n, F.transform(F.slice("_h", 1, F.size("_h") - (n - 1)), key(n))).otherwise(none) for n in lengths]
    return each[0] if len(each) == 1 else F.concat(*each)


def _lookup_keys(bench: DataFrame, window: int) -> DataFrame:
    """_key: those of benchmark_windows(), and of each window with a single word read as a name."""
    place = F.explode(F.sequence(F.lit(0), F.col("_len") - 1)).alias("_j")
    named = bench.where("not _loose").select("_len", "_canon", place).select("_len", F.transform("_canon", lambda c, i: F.xxhash64(F.when(i == F.col("_j"), F.lit(NAME)).otherwise(c))).alias("_h"))
    return bench.select("_key").unionByName(named.select(_whole_key(window).alias("_key")))


def _whole_key(window: int) -> Column:
    """The key of all _len hashes in _h."""
    return F.coalesce(*(F.when(F.col("_len") == n, _hashed(F.lit(0), n)) for n in range(1, window + 1)))


def _windows(x: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """x(_h, ...) -> one row a window: _len, _at, _key."""
    each = [
        F.when(F.size("_h") >= n, F.transform(F.sequence(F.lit(0), F.size("_h") - n), _entry(n))).otherwise(F.array().cast("array<struct<_len:int,_at:int,_key:bigint>>"))
        for n in lengths
    ]
    return x.select(*keep, F.explode(F.concat(*each)).alias("_w")).select(*keep, "_w.*")


def _word_hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _usable(seq: Column, window: int, min_literal: int) -> Column:
    """Where the windows with enough literal words begin."""
    size = F.size(seq)
    length = F.least(F.lit(window), size)
    places = F.when(size > 0, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda at: F.size(F.filter(F.slice(seq["c"], at + 1, length), lambda c: ~_is_slot(c))) >= min_literal)


def benchmark_windows(items: DataFrame, *, window: int, min_literal: int, item_id: str, text: str, loose: bool = False) -> DataFrame:
    """(_item, _n, _at, _len, _key, _canon, _pattern) for every window of every item that can be found."""
    x = items.select(F.col(item_id).alias("_item"), F.col(text).alias("_t")).where(F.col("_t").isNotNull()).withColumn("_seq", canonical(F.col("_t")))
    x = x.select("_item", F.least(F.lit(window), F.size("_seq")).alias("_len"), _read(F.col("_seq"), loose).alias("_read"), F.explode(_usable(F.col("_seq"), window, min_literal)).alias("_at"))
    x = x.withColumn("_win", F.slice("_read", F.col("_at") + 1, F.col("_len"))).withColumn("_canon", F.col("_win")["c"])
    x = x.withColumn("_h", _word_hashes(F.col("_canon")))
    x = x.select("_item", "_at", "_len", _whole_key(window).alias("_key"), "_canon", _slots(F.col("_win")).alias("_pattern"))
    sizes = x.groupBy("_item").agg(F.count(F.lit(1)).alias("_n"))
    return x.join(sizes, "_item")


def _in_windows(texts: DataFrame, items: DataFrame, *, window: int, min_literal: int, share: float, enough: int, item_id: str, item_text: str) -> DataFrame:
    """(_id, _th, _item, _hit): the items found by their windows."""
    of_items = {"window": window, "min_literal": min_literal, "item_id": item_id, "text": item_text}
    both = [benchmark_windows(items, loose=loose, **of_items).withColumn("_loose", F.lit(loose)) for loose in READINGS]
    bench = stored(both[0].unionByName(both[1]), "windows")
    lengths = sorted(r["_len"] for r in bench.select("_len").distinct().collect())  # at most `window` numbers
    if not lengths:
        lengths = [window]
    keys = stored(_lookup_keys(bench, window).distinct(), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    # All documents are scanned for keys alone; words and slots are compared in the few documents with a hit.
    scan = texts.select("_id", "_th", F.explode(F.array(canonical_words(F.col("_text")))).alias("_c"))  # generators keep what is read several times from being made as often
    scan = scan.select("_id", "_th", F.explode(F.array(_word_hashes(read_as(F.col("_c"), True)))).alias("_h"))
    scan = scan.select("_id", "_th", F.explode(_keys(lengths)).alias("_key"))
    near = stored(scan.join(keys, "_key", "left_semi").select("_id", "_th").distinct(), "candidates")
    x = texts.join(near, ["_id", "_th"], "left_semi").select("_id", "_th", canonical(F.col("_text")).alias("_seq"))
    x = x.select("_id", "_th", F.explode(F.array(*(F.struct(F.lit(loose).alias("_loose"), _read(F.col("_seq"), loose).alias("_seq")) for loose in READINGS))).alias("_r"))
    x = x.select("_id", "_th", "_r.*").withColumn("_h", _word_hashes(F.col("_seq")["c"]))
    found = _windows(x, lengths, ["_id", "_th", "_loose", "_seq"]).select("_id", "_th", "_loose", "_len", "_key", F.slice("_seq", F.col("_at") + 1, F.col("_len")).alias("_win")).join(bench, ["_loose", "_len", "_key"])
    found = found.where((F.col("_win")["c"] == F.col("_canon")) & (_slots(F.col("_win")) == F.col("_pattern")))
    places = found.groupBy("_id", "_th", "_loose", "_item", "_n", "_at").agg(F.count(F.lit(1)).alias("_times"))
    matched = places.groupBy("_id", "_th", "_loose", "_item", "_n").agg(F.count(F.lit(1)).alias("_hit"))
    return matched.where(F.col("_hit") >= F.least(F.lit(enough), F.ceil(F.col("_n") * share))).select("_id", "_th", "_item", "_hit")


def _in_sequence(texts: DataFrame, items: DataFrame, *, window: int, min_literal: int, item_id: str, item_text: str) -> DataFrame | None:
    """(_id, _th, _item, _hit): the items without a usable window, by their exact words; None where there is no such item."""
    t = F.col("_t")
    x = items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_t")).where(t.isNotNull())
    x = x.where(F.size(_usable(canonical(t), window, min_literal)) == 0).select("_item", plain_words(t).alias("_p")).where(F.size("_p") > 0)
    x = x.withColumn("_len", F.least(F.lit(window), F.size("_p"))).withColumn("_h", _word_hashes(F.slice("_p", 1, window)))
    x = stored(x.select("_item", "_len", _whole_key(window).alias("_key"), F.array_join("_p", " ").alias("_said")), "sequences")
    lengths = sorted(r["_len"] for r in x.select("_len").distinct().collect())  # at most `window` numbers
    if not lengths:
        return None
    plain = texts.select("_id", "_th", plain_words(F.col("_text")).alias("_p"))
    scan = plain.withColumn("_h", _word_hashes(F.col("_p")))
    begun = _windows(scan.select("_id", "_th", F.size("_p").alias("_size"), "_h"), lengths, ["_id", "_th", "_size"]).where("_len > 1 or _size = 1")
    begun = stored(begun.join(x, ["_len", "_key"]).select("_id", "_th", "_item", "_said").distinct(), "begun")
    whole = plain.select("_id", "_th", F.array_join("_p", " ").alias("_all"))
    has = F.concat(F.lit(" "), "_all", F.lit(" ")).contains(F.concat(F.lit(" "), "_said", F.lit(" ")))
    return whole.join(begun, ["_id", "_th"]).where(has).select("_id", "_th", "_item", F.lit(1).cast("long").alias("_hit")).distinct()


def hits(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, min_literal: int = MIN_LITERAL, share: float = SHARE, enough: int = ENOUGH, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_id, _th, items): the documents that hold benchmark items, and which."""
    texts = keyed(docs, id_col, text_col)
    of_items = {"window": window, "min_literal": min_literal, "item_id": item_id, "item_text": item_text}
    matched = _in_windows(texts, items, share=share, enough=enough, **of_items)
    if (exact := _in_sequence(texts, items, **of_items)) is not None:
        matched = matched.unionByName(exact)
    matched = matched.groupBy("_id", "_th", "_item").agg(F.max("_hit").alias("_hit"))
    return matched.groupBy("_id", "_th").agg(F.array_sort(F.collect_list("_item")).alias("items"), F.sum("_hit").alias("n_windows"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items (sorted benchmark ids), n_windows for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = stored(hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "hits")
    every = keyed(docs, "doc_id", "text").select("_id", "_th")
    return every.join(found, ["_id", "_th"], "left").select(
        shown_id(F.col("_id")).alias("doc_id"),
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
    )
