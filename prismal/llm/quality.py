"""Quality rules under weak supervision (DataFrame operations only).

Each rule looks at a few counts of the whole text and votes bad (0), good (2)
or abstains (1). Nobody says how far a rule is to be trusted: expectation-
maximisation over the whole corpus estimates the share of good documents and
each rule's accuracy where it votes. A document is kept when its posterior
probability of being good is at least a half; no single rule has to pass.

Documents with the same votes are one case to the model, so that the corpus
is first counted by vote pattern. There are at most 3 ** len(RULES) patterns
whatever the corpus size; the whole estimation is one fold over their array
in one row, and the table of posteriors is broadcast under that bound.

`base_failed` (fewer than 50 words, or more than half of the words inside
repeated 3-word windows) always rejects. Null and empty texts have no words
and fail it. Rows are judged one by one: repeated rows get equal verdicts, and
a tie (a posterior of exactly a half) is kept; an empty table gives no rows.
A very long text is counted like any other, by expressions whose depth doesn't
depend on it. All columns of the input travel in one struct, whatever their
names; those named like a result of `judged` are replaced by it there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import SPACE, packed, unpacked, words
from prismal.session import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 40
SYMBOLS = "#*$%&|<>"

#: A word of letters, apostrophes and hyphens, perhaps with one mark of punctuation behind it; no group repeats, for the engine would recurse.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}[\p{L}\p{M}'’-]*+[.,;:!?]?+(?![^\x20\x09-\x0D])"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_letters", "n_capitals", "n_shouts", "n_distinct", "n_plain")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_row, _counts): the columns of docs, and the counts BASE and EXTRA, each a long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    x = docs.select(packed(docs).alias("_row"), text.alias("_text"), words(F.col(text_col)).alias("_words"), lines.alias("_lines"))
    x = x.withColumn(
        "_grams",
        F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    x = x.withColumn("_twice", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    x = x.withColumn("_sorted", F.when(F.col("_twice"), F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))

    def repeated(e: Column, k: Column) -> Column:
        return F.coalesce(F.get("_sorted", k - 1)["g"] == e["g"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["g"] == e["g"], F.lit(False))

    places = F.array_sort(F.transform(F.filter("_sorted", repeated), lambda e: e["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    letters = F.regexp_replace("_text", r"[^\p{L}]+", "")
    counts = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace("_text", f"{SPACE}+", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_twice"), covered).otherwise(0).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_letters": F.length(letters).cast("long"),
        "n_capitals": F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long"),
        "n_shouts": (F.length("_text") - F.length(F.translate("_text", "!?", ""))).cast("long"),
        "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
        "n_plain": F.regexp_count("_text", F.lit(PLAIN)).cast("long"),
    }
    # One element an array: a generator keeps the optimiser from copying these costly expressions into every later filter.
    return x.select("_row", F.explode(F.array(F.struct(*(v.alias(k) for k, v in counts.items())))).alias("_counts"))


def _n(name: str) -> Column:
    return F.col("_counts")[name]


def _bad(defect: Column) -> Column:
    return F.when(defect, F.lit(0)).otherwise(F.lit(1))


def _at_least(a: str, b: str, share: float) -> Column:
    return _n(a) >= _n(b) * share


#: name -> vote. A rule about one defect has nothing to say about texts without it; the last one also speaks for a text.
RULES = {
    "symbols": lambda: _bad((_n("n_words") > 0) & _at_least("n_symbols", "n_words", 0.1)),
    "repeats": lambda: _bad((_n("n_words") >= 10) & _at_least("n_repeat_words", "n_words", 0.3)),
    "lines": lambda: _bad((_n("n_lines") >= 4) & _at_least("n_dup_lines", "n_lines", 0.3)),
    "capitals": lambda: _bad((_n("n_letters") >= 20) & _at_least("n_capitals", "n_letters", 0.3)),
    "shouts": lambda: _bad((_n("n_words") >= 10) & _at_least("n_shouts", "n_words", 0.2)),
    "length": lambda: _bad((_n("n_words") > 0) & ~_n("word_chars").between(2 * _n("n_words"), 15 * _n("n_words"))),
    "variety": lambda: _bad((_n("n_words") >= 20) & (_n("n_distinct") < F.sqrt(_n("n_words")))),
    "wording": lambda: F.when(_n("n_words") < 10, F.lit(1)).when(_at_least("n_plain", "n_words", 0.85), F.lit(2)).when(_at_least("n_plain", "n_words", 0.6), F.lit(1)).otherwise(F.lit(0)),
}


def votes() -> Column:
    """The vote pattern, one digit a rule."""
    return F.concat(*(rule().cast("string") for rule in RULES.values()))


def posteriors(patterns: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """patterns(votes, n) -> (votes, p_good), by expectation-maximisation in a single row.

    The state is an array: the share of good documents, then each rule's
    accuracy. A round weighs every pattern by its posterior, and takes as a
    rule's accuracy the share of its votes that agree with the posteriors;
    ten votes with one mistake are added to each rule, and estimates are kept
    between 0.55 and 0.99, so that a rare rule still says something.
    """
    m = len(RULES)
    rows = patterns.agg(F.collect_list(F.struct(F.transform(F.split("votes", ""), lambda v: v.cast("int") - 1).alias("v"), F.col("n").cast("double").alias("n"), F.col("votes").alias("votes"))).alias("ps"))

    def logit(p: Column) -> Column:
        return F.log(p / (1 - p))

    def p_good(state: Column, v: Column) -> Column:
        odds = logit(F.get(state, F.lit(0)))
        for j in range(m):
            odds = odds + F.get(v, F.lit(j)) * logit(F.get(state, F.lit(j + 1)))
        return 1 / (1 + F.exp(-odds))

    def total(js: Column, weight) -> Column:
        return F.aggregate(js, F.lit(0.0), lambda a, p: a + weight(p))

    def accuracy(js: Column, j: int) -> Column:
        def agreed(p: Column) -> Column:
            vote = F.get(p["v"], F.lit(j))
            return F.when(vote == 1, p["g"]).when(vote == -1, p["n"] - p["g"]).otherwise(0.0)

        cast = total(js, lambda p: F.when(F.get(p["v"], F.lit(j)) != 0, p["n"]).otherwise(0.0))
        return F.least(F.lit(0.99), F.greatest(F.lit(0.55), (total(js, agreed) + 9) / (cast + 10)))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform("ps", lambda p: F.struct(p["v"].alias("v"), (p["n"] * p_good(state, p["v"])).alias("g"), p["n"].alias("n")))

        def renewed(js: Column) -> Column:
            share = total(js, lambda p: p["g"]) / total(js, lambda p: p["n"])
            return F.array(F.least(F.lit(0.98), F.greatest(F.lit(0.02), share)), *(accuracy(js, j) for j in range(m)))

        return F.get(F.transform(F.array(weighed), renewed), F.lit(0))

    begin = F.array(F.lit(0.8), *(F.lit(0.95) for _ in range(m)))
    fitted = rows.where(F.size("ps") > 0).withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step))
    return fitted.select("state", F.explode("ps").alias("p")).select(F.col("p")["votes"].alias("votes"), p_good(F.col("state"), F.col("p")["v"]).alias("p_good"))


def verdicts(counted: DataFrame) -> DataFrame:
    """with_counts() -> (_row, _counts, _verdict), the last with base_failed, p_good and kept. It is read twice, so `counted` should be stored."""
    x = counted.withColumn("_votes", votes())
    model = posteriors(x.groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_votes", "votes"))
    model = stored(model.select(F.col("votes").alias("_votes"), F.col("p_good").alias("_p")), "posteriors")
    failed = (_n("n_words") < MIN_WORDS) | (100 * _n("n_repeat_words") > MAX_REPEAT_PERCENT * _n("n_words"))
    verdict = F.struct(failed.alias("base_failed"), (~failed & (F.col("_p") >= 0.5)).alias("kept"), F.col("_p").alias("p_good"))
    return x.join(F.broadcast(model), "_votes").select("_row", "_counts", verdict.alias("_verdict"))  # at most 3 ** len(RULES) rows


def judged(counted: DataFrame) -> DataFrame:
    """The rows of with_counts() with BASE, EXTRA, base_failed, p_good and kept."""
    own = {c: _n(c) for c in (*BASE, *EXTRA)} | {c: F.col("_verdict")[c] for c in ("base_failed", "kept", "p_good")}
    return verdicts(counted).select(*unpacked("_row", counted.schema["_row"].dataType.names, own))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = stored(with_counts(docs).select(F.col("_row").dropFields("text").alias("_row"), "_counts"), "counts")
    return judged(counted).select("doc_id", *BASE, "base_failed", "kept", "p_good")
