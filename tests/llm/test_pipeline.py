"""The pipeline's stages, each against a plain version of what it promises."""

import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from prismal.llm import quality
from prismal.session import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def as_dict(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), "test"))
    return out


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert set(stages[0].columns) < set(stages[-1].columns) and len(cp.STAGES) == 5


def test_quality(stages):
    kept = {r.doc_id for r in quality.judged(quality.with_counts(stages[0])).where("kept").collect()}
    before, after = as_dict(stages[0]), as_dict(stages[1])
    assert set(after) == kept and all(after[i] == before[i] for i in after)


def test_line_dedup(stages):
    before, after = as_dict(stages[1]), as_dict(stages[2])
    assert set(before) == set(after)
    for i, r in after.items():
        lines = iter(before[i].text.split("\n"))
        assert r.text == "" or all(x in lines for x in r.text.split("\n"))
        assert r.n_chars == len(r.text)


def test_near_duplicates(stages):
    def shingles(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    before, after = as_dict(stages[2]), as_dict(stages[3])
    sets = {i: shingles(r.text) for i, r in before.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(after) == {i for i in ids if find(i) == i}


def test_decontamination(stages, spark, sf_dir):
    plain = lambda x: " ".join(re.findall(r"\w+", re.sub(r"[^\w\s]", "", (x or "").lower())))
    items = [f" {plain(r.text)} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = as_dict(stages[3]), as_dict(stages[4])
    leaked = {i for i, r in before.items() if any(b in f" {plain(r.text)} " for b in items)}
    assert not leaked & set(after)
    for i in set(before) - set(after) - leaked:  # what else went shares long passages with an item
        words = plain(before[i].text).split()
        grams = {tuple(words[k : k + 5]) for k in range(len(words))}
        assert any(len(grams & {tuple(b.split()[k : k + 5]) for k in range(len(b.split()))}) >= 2 for b in items)


def test_mix(stages):
    rows = stages[-1].collect()
    assert {r.doc_id for r in rows} == set(as_dict(stages[4]))
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 64 and all(0 <= r.taken <= 3 * r.size for r in own)


def test_repeated_and_missing_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars int")
    for df in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            assert stage(spark, df, sf_dir).count() <= df.count()


def test_line_dedup_keeps_a_copied_document(spark, sf_dir):
    copied = "\n".join(f"line {k} of a clean document about subject number {k * k}" for k in range(8))
    texts = [copied] * 30 + [f"page {i} has its own words {i * i}\nread more on our site" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    after = stored(cp.line_dedup(spark, docs, sf_dir), "test")
    kept = as_dict(cp.near_dedup(spark, after, sf_dir))
    assert [i for i, r in kept.items() if r.text == copied] == [0] and not set(kept) & set(range(1, 30))
    assert all(r.text == texts[i].split("\n")[0] for i, r in kept.items() if i)  # boilerplate still goes


def test_repeated_rows_are_rows(spark, sf_dir):
    text = " ".join(f"w{k}" for k in range(40))
    short = [(None, f"only {i} here again", "en", "t", 1) for i in range(3)]
    docs = spark.createDataFrame([(i, text, "en", "s", 1) for i in (None, 7, 7, 5, 5, None)] + [(None, text + " " + text[::-1], "en", "s", 1)] * 3 + short, "doc_id long, text string, lang string, source string, n_chars int")
    after = [(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, sf_dir).collect()]
    assert sorted(after, key=str) == sorted([(5, text), (None, text + " " + text[::-1])] + [(None, r[1]) for r in short], key=str)


def test_mix_of_repeated_rows(spark, sf_dir):
    rows = [(1, "a " * 8, "en", s, 1) for s in "stu" for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = cp.mix(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted((r[0], r[3]) for r in rows)
    for source in "stu":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 64, source


def test_extra_columns_travel_along(spark, sf_dir):
    """Columns with the stages' own names change nothing and come out as they went in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["_row", "_docs", "_id", "_th", "_text", "_counts", "n_words", "kept", "n_lines", "_c", "component_id", "_hit", "_src", "_q", "votes"]
    dressed = docs.select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in names))
    plain = docs
    for name, stage in cp.STAGES[:-1]:
        plain, dressed = stored(stage(spark, plain, sf_dir), "plain"), stored(stage(spark, dressed, sf_dir), "dressed")
        assert dressed.columns == [*docs.columns, *names], name
        assert {tuple(r) for r in dressed.select(docs.columns).collect()} == {tuple(r) for r in plain.collect()}, name
        assert all(r[0] == f"_row of {r[1]}" for r in dressed.select("_row", "doc_id").collect()), name
    last = cp.STAGES[-1][1]
    taken = {r.doc_id: r.taken for r in last(spark, plain, sf_dir).collect()}
    assert {r.doc_id: r.taken for r in last(spark, dressed, sf_dir).collect()} == taken


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "none")
        assert docs.count() == 0
