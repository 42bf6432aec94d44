"""Each operator against a plain brute-force version, on the small tables and on awkward rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prismal.llm import decontamination, htmltext, licenses, linededup, mixing, neardup, quality, substrings, tokencount, urlfilter
from prismal.llm.common import NO_ID

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, _id int, _text string"


def awkward():
    rng = random.Random(3)
    passage = [f"p{rng.randrange(400)}" for _ in range(60)]
    rows = [(1, None, "s"), (2, "", "s"), (3, " \t\n", None), (4, "one two", None), (5, "One Two", "s"), (6, "one\x0btwo\x1fthree", "t"), (None, "no id here at all", "t"), (7, "x " * 100, "t"), (8, "x " * 130 + "y", "t")]
    for i in range(20, 34):
        noise = [f"n{rng.randrange(5000)}" for _ in range(30)]
        rows.append((i, " ".join(noise[:15] + passage[: rng.randrange(30, 61)] + noise[15:]), "t"))
    base = [f"b{k}" for k in range(120)]
    for i in range(40, 52):
        copy = list(base)
        for _ in range(i - 40):
            copy[rng.randrange(120)] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(copy), "t"))
    rows += [(60, "same text " * 30, "u"), (60, "same text " * 30, "u"), (61, " ".join(f"w{k}" for k in range(20000)), "u"), (62, "a b " * 300, "u"), (63, "\n".join(["line one here"] * 3 + ["other", " "]), "u")]
    return [(i, t, "en", s, 1, 7, "clash") for i, t, s in rows]


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame(awkward(), DOCS)
    none = spark.createDataFrame([], DOCS)
    return [t.cache() for t in (small, odd, none)]


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_token_counts(tables):
    machine = tokencount.automaton(tokencount.VOCABULARY)
    pieces = set(tokencount.read_vocabulary(tokencount.VOCABULARY))
    longest = max(map(len, pieces))

    def greedy(word):
        data, n = b" " + word.encode(), 0
        while data:
            size = next(k for k in range(min(longest, len(data)), 0, -1) if data[:k] in pieces)
            data, n = data[size:], n + 1
        return n

    known = {}
    for t in tables:
        want = []
        for i, text in rows(t, "doc_id", "text"):
            found = WORD.findall(text or "")
            for w in found:
                if w not in known:
                    known[w] = greedy(w)
            want.append((i, len(found), sum(known[w] for w in found)))
        same(rows(tokencount.counted(t), "doc_id", "n_words", "n_tokens"), want)
    long = "ab" * 5000
    assert machine.count_one(b" " + long.encode()) == greedy(long)


def test_mixing(tables):
    for t in tables:
        got = rows(mixing.mixed_sizes(t), "doc_id", "source", "size", "source_size", "target", "taken")
        texts = rows(t, "doc_id", "text", "source")
        same([(g[0], g[1], g[2]) for g in got], [(i, s, len(WORD.findall(x or ""))) for i, x, s in texts])
        sizes = Counter()
        for _, x, s in texts:
            sizes[s] += len(WORD.findall(x or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
        target, free, left = {}, set(sizes), sum(sizes.values())
        while free:
            share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
            over = [s for s in free if share[s] > 3 * sizes[s]]
            if not over:
                target |= share
                break
            for s in over:
                target[s] = 3 * sizes[s]
                left -= target[s]
                free.discard(s)
        taken = Counter()
        for _, s, size, source_size, goal, n in got:
            assert source_size == sizes[s] and abs(goal - target[s]) < 1e-6 and 0 <= n <= 3 * size
            taken[s] += n
        for s, goal in target.items():
            assert abs(taken[s] - goal) <= 64, (s, taken[s], goal)
        same(got, rows(mixing.mixed_sizes(t.repartition(5)), "doc_id", "source", "size", "source_size", "target", "taken"))


def test_apportionment(spark):
    rng = random.Random(1)
    for seats in (0, 1, 7, 100, 1001):
        votes = [(k, float(rng.choice([0, 1, 5, 40, 900, 12345]))) for k in range(12)]
        won = Counter()
        for _ in range(seats):
            best = max((v / (2 * won[k] + 1), -k) for k, v in votes)
            won[-best[1]] += 1
        df = spark.createDataFrame([(k, v, seats) for k, v in votes], "k int, v double, h long")
        got = mixing.apportioned(df, ["h"], [df.k], vote="v", house="h", quota="q")
        assert {r.k: r.q for r in got.collect()} == {k: won[k] for k, _ in votes}


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality(tables, spark, sf_dir):
    for t in tables:
        got = rows(quality.judged(quality.with_counts(t)), "doc_id", *quality.BASE, "base_failed")
        want = [(i, *(c := base_counts(x)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, x in rows(t, "doc_id", "text")]
        same(got, want)


def test_quality_of_hostile_words(spark):
    """Words without end and words of thousands of parts are counted like others."""
    texts = ["a-" * 200_000, "x" * 1_000_000, "a-a-a-a " * 60_000, "'" * 50_000, "ab " * 100 + "a’b " * 100, None, ""]
    got = rows(quality.judged(quality.with_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))), "doc_id", *quality.BASE)
    same(got, [(i, *base_counts(t)) for i, t in enumerate(texts)])


CLASH = ["_row", "_counts", "_verdict", "_votes", "_words", "_lines", "_text", "_p", "_host", "_drop", "_all", "_here", "_kept", "votes", "n_words", "p_good", "kept", "base_failed", "n_lines", "n_dropped", "_hit", "h"]


def test_clashing_columns(spark, tables):
    """Columns that bear the operators' own names change nothing, and stay unless a result has their name."""
    plain = tables[0]
    dressed = plain.selectExpr("*", *(f"'other' AS `{c}`" for c in CLASH if c not in plain.columns)).withColumn("_text", F.lit("other"))
    for run, own in ((lambda t: quality.judged(quality.with_counts(t)), (*quality.BASE, *quality.EXTRA, "base_failed", "kept", "p_good")), (linededup.cleaned, ("text", "n_lines", "n_dropped"))):
        got = run(dressed)
        same(rows(got, "doc_id", *own), rows(run(plain), "doc_id", *own))
        assert {c for c in CLASH if c not in own} <= set(got.columns) and all(r[0] == "other" for r in rows(got, "_row"))


def fitted(patterns, rounds):
    """Expectation-maximisation by plain loops: votes -> posterior."""
    m = len(quality.RULES)
    share, right = 0.8, [0.95] * m
    def posterior(v):
        odds = math.log(share / (1 - share)) + sum((int(c) - 1) * math.log(right[j] / (1 - right[j])) for j, c in enumerate(v))
        return 1 / (1 + math.exp(-odds))
    for _ in range(rounds):
        good = {v: n * posterior(v) for v, n in patterns.items()}
        agreed, cast = [0.0] * m, [0.0] * m
        for v, n in patterns.items():
            for j, c in enumerate(v):
                if c != "1":
                    cast[j] += n
                    agreed[j] += good[v] if c == "2" else n - good[v]
        share = min(0.98, max(0.02, sum(good.values()) / sum(patterns.values())))
        right = [min(0.99, max(0.55, (a + 9) / (c + 10))) for a, c in zip(agreed, cast)]
    return {v: posterior(v) for v in patterns}


def test_estimation_against_plain_loops(spark):
    rng = random.Random(5)
    patterns = {"".join(rng.choice("0112") for _ in quality.RULES): rng.randrange(1, 900) for _ in range(60)}
    got = quality.posteriors(spark.createDataFrame(list(patterns.items()), "votes string, n bigint"))
    want = fitted(patterns, quality.ROUNDS)
    found = {r.votes: r.p_good for r in got.collect()}
    assert set(found) == set(want) and all(abs(found[v] - want[v]) < 1e-9 for v in want)


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    judged = quality.op4_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    table = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert table.get((1, True), 0) >= 0.98 * (table.get((1, True), 0) + table.get((1, False), 0))
    assert table.get((0, False), 0) >= 0.9 * (table.get((0, True), 0) + table.get((0, False), 0))


def test_url_filter(spark, sf_dir):
    urls = [None, "", "no scheme", "http://com", "http://A.COM/", "https://example.com/en/x?y", "http://www.example.com/en/", "http://m.www.EXAMPLE.com/en/9#t", "http://example.com/EN/", "x://net/es/", "x://netx/es/", "x://a.net/fr", "x://a.net?/fr/", "x://a.net#/fr/", "http://a.com/b://c", "://net/fr/1", "http:///en/", "http://é.com/é"]
    odd = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(3, "http://com", "h")], "page_id long, url string, host string")

    def want(url):
        host = path = ""
        if url and "://" in url:
            host, path, _ = re.fullmatch(r"([^/?#]*)([^?#]*)(.*)", url.split("://", 1)[1], re.S).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    for t in (odd, spark.read.parquet(f"{sf_dir}/pages.parquet"), odd.limit(0)):
        same(rows(urlfilter.filtered(t), "page_id", "host", "path", "rule", "verdict"), [(i, *want(u)) for i, u in rows(t, "page_id", "url")])
    same(rows(urlfilter.filtered(odd, []), "verdict"), [("allow",)] * odd.count())


def test_url_filter_of_long_hosts(spark):
    """A host of many labels and a path of a megabyte, in linear time."""
    began = time.time()
    urls = ["http://" + "a." * 50_000 + "example.com/en/x", "http://" + "b" * 500_000 + "/en/", "http://example.com/en/" + "x/" * 500_000, "http://www.example.com/en/", None, "no scheme", "http://" + "." * 20_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filtered(pages).collect()}
    assert got == {0: ("example.com/en/", "block"), 1: (None, "allow"), 2: ("example.com/en/", "block"), 3: ("www.example.com/en/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow")}
    assert time.time() - began < 60


def test_digest_collisions(tmp_path):
    import numpy as np

    path = tmp_path / "list"
    path.write_bytes(urlfilter.packed([("a.com", "/", "block"), ("b.com", "/", "allow")]))
    array = urlfilter.DigestArray(str(path))
    twin = np.array([array.keys[0]] * 2, np.uint64)
    text = array.texts[array.ends[0] : array.ends[1]].tobytes()
    assert array.find([b"other/", text], twin).tolist() == [-1, 0]


def test_line_dedup(tables):
    for t in tables:
        got = rows(linededup.cleaned(t), "doc_id", "text", "n_lines", "n_dropped")
        docs = rows(t, "doc_id", "source", "text")
        pages, seen = Counter(s for _, s, _ in docs), Counter()
        strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
        for _, s, x in docs:
            seen.update((s, y) for y in {strip(y) for y in (x or "").split("\n")} if y)
        want = []
        for i, s, x in docs:
            if x is None:
                want.append((i, None, 0, 0))
                continue
            lines = x.split("\n")
            kept = [y for y in lines if not (strip(y) and seen[s, strip(y)] >= 5 and seen[s, strip(y)] > 0.1 * pages[s])]
            want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
        same(got, want)


def test_substrings(tables):
    for t in tables:
        docs = [(i, WORD.findall(x or "")) for i, x in rows(t, "doc_id", "text")]
        seen = Counter(tuple(w[k : k + 35]) for _, w in docs for k in range(len(w) - 34))
        want = []
        for i, w in docs:
            gone = {k + d for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for d in range(35)}
            kept = " ".join(x for k, x in enumerate(w) if k not in gone)
            want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        same(rows(substrings.deduplicated(t), "doc_id", "n_words", "n_removed", "kept_sha256"), want)


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(tables, width, percent):
    bands = {"bands": 40, "rows": 4} if percent == 80 else {}
    for t in tables:
        docs = [(i, shingles(x, width)) for i, x in rows(t, "doc_id", "text")]
        ids = sorted({i for i, _ in docs if i is not None})
        root = {i: i for i in ids}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        named = [(i, s) for i, s in docs if i is not None and s]
        for k, (i, s) in enumerate(named):
            for j, u in named[:k]:
                if i != j and 100 * len(s & u) >= percent * len(s | u):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        want = [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in docs]
        same(rows(neardup.linked(t, width=width, percent=percent, **bands), "doc_id", "n_shingles", "component_id", "kept"), want)


def test_near_duplicates_in_a_group_of_alike_texts(spark):
    """Copies with more and more changes, some above and some under the threshold, in one group."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    docs = []
    for i in range(120):
        copy = list(docs[rng.randrange(len(docs))] if docs and i % 3 == 0 else base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
        docs.append(copy[rng.randrange(6) :])
    sets = [shingles(" ".join(d), 3) for d in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    assert len(set(root)) > 5
    same(rows(neardup.linked(table), "doc_id", "component_id"), list(enumerate(root)))


def test_licenses(tables, spark):
    mit = next(x for n, x in licenses.KNOWN if n == "MIT")
    odd = [(1, mit, "MIT", "MIT"), (2, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ,"), "MIT", "MIT"), (3, "prose\nlicenced under the Apache Licence, version 2.0\nmore", "Apache-2.0", None), (4, "the MIT License is nice", None, None), (5, None, None, None), (6, "", None, None), (6, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "CC-BY-NC-4.0")]
    df = spark.createDataFrame([(i, x) for i, x, _, _ in odd], "doc_id long, text string")
    same(rows(licenses.scanned(df), "doc_id", "licenses", "whole"), [(i, [n] if n else [], whole) for i, _, n, whole in odd])
    notices = {x: n for n, x in licenses.KNOWN}
    for t in tables:
        want = [(i, sorted({notices[y] for y in (x or "").split("\n") if y in notices})) for i, x in rows(t, "doc_id", "text")]
        same(rows(licenses.scanned(t), "doc_id", "licenses"), want)


def test_licenses_in_runs_of_lines(spark):
    """Full texts of the folder, wrapped anew, behind and before other lines; and what isn't an entire text."""
    known = dict(licenses.known_texts())
    rng = random.Random(2)

    def wrapped(text):
        out, line = [], []
        for w in text.split():
            line.append(w)
            if rng.random() < 0.12:
                out.append(" ".join(line))
                line = []
        return "\n".join([*out, " ".join(line)])

    # Copyright lines are known by their lines: only texts without them can be wrapped anew.
    cases = [("# A read-me\n\nSome words about it.\n\n" + known["MIT"].replace(". ", ".\n\n"), ["MIT"], None)]
    cases += [("A line.\n" + known[n] + "\nA line behind.", [n], None) for n in ("GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0")]
    full = (licenses.Path(licenses.__file__).parent / "known" / "Apache-2.0.txt").read_text()
    cases += [(full, ["Apache-2.0"], "Apache-2.0"), (full.partition("END OF TERMS")[0], ["Apache-2.0"], "Apache-2.0"), (full.replace("perpetual", "eternal"), ["Apache-2.0"], None), (full.partition("END OF TERMS")[0].replace("perpetual", "eternal"), [], None)]
    cases += [(wrapped(known["Zlib"]), ["Zlib"], "Zlib"), (wrapped(known["BSD-2-Clause"]).upper(), ["BSD-2-Clause"], "BSD-2-Clause"), ("x " + known["Zlib"], [], None), (known["Zlib"] + "\n\n" + known["ISC"], ["ISC", "Zlib"], None)]
    cases += [("licence " * 200_000, [], None), ("\n" * 50_000 + "license", [], None), ("x y\n" * 200_000 + "Licensed under CC0 1.0.", ["CC0-1.0"], None)]
    df = spark.createDataFrame([(k, x, "clash") for k, (x, _, _) in enumerate(cases)], "doc_id long, text string, anchor string")
    same(rows(licenses.scanned(df), "doc_id", "licenses", "whole"), [(k, n, w) for k, (_, n, w) in enumerate(cases)])


def test_decontamination(tables, spark, sf_dir):
    items = [(1, "If Maria walks 12 km in 3 hours and then 12 km more in 4 hours how far does she go each hour on the way"), (2, "short one"), (3, None), (4, ""), (5, "seven words stand here without any slot")]
    bench = spark.createDataFrame([(i, x, 9) for i, x in items], "item_id long, text string, doc_id int")
    cases = [
        (1, "Prose before it. " + items[0][1] + " and prose behind.", [1]),
        (2, "If Peter walks 50 miles in 7 days and then 50 miles more in 9 days how far does she go each hour", [1]),
        (3, "Then Peter walks 50 miles in 7 days and then 60 miles more in 9 days how", []),  # the two distances differ
        (4, None, []),
        (5, "", []),
        (6, "Seven, words stand here: without any slot!", [5]),
        (None, "Seven words stand here without any slot", [5]),
        (6, "nothing of the kind is in this text at all", []),
    ]
    docs = spark.createDataFrame([(i, x, 1) for i, x, _ in cases], "doc_id long, text string, item_id int")

    def found(d, b):
        hits = decontamination.hits(d, b)
        return {(r._id, r._th): r["items"] for r in hits.collect()}

    got = found(docs, bench)
    keys = {(r._id, r._th): r._text for r in decontamination.keyed(docs, "doc_id", "text").collect()}
    for i, x, want in cases:
        hit = next(v for k, v in ((k, got.get(k, [])) for k, t in keys.items() if k[0] == (NO_ID if i is None else i) and t == (x or "")))
        assert hit == want, (i, x, hit)
    assert not found(docs, bench.limit(0)) and not found(docs.limit(0), bench)
    # Verbatim passages of the tables: exactly the documents that hold a whole item, or a fifth of its windows.
    texts = rows(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    plain = lambda x: re.findall(r"\w+", re.sub(r"[^\w\s]", "", (x or "").lower()))
    joined = {i: " ".join(plain(x)) for i, x in texts}
    got = {r._id for r in decontamination.hits(tables[0], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    whole = {i for i, x in rows(tables[0], "doc_id", "text") for y in (" ".join(plain(x)),) if any(f" {b} " in f" {y} " for b in joined.values())}
    assert whole <= got
    for i, x in rows(tables[0], "doc_id", "text"):
        if i in got - whole:
            words = plain(x)
            grams = {tuple(words[k : k + 4]) for k in range(len(words))}
            assert any(len(grams & {tuple(b.split()[k : k + 4]) for k in range(len(b.split()))}) >= 3 for b in joined.values()), i


def test_decontamination_of_short_and_slotted_items(spark):
    items = ["Compute 12 + 30 - 4 + 7 = 45", "Who wrote Hamlet?", "Maria buys 12 apples in Rome", "Then Maria's brother carried 12kg of flour home", "Yes", "pages 12-15 of it are missing from the book", "+ ="]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    cases = [
        ("Some prose, then compute 12 + 30 - 4 + 7 = 45, and more.", [0]),
        ("Some prose, then compute 12 + 30 - 4 + 8 = 46, and more.", []),
        ("We ask: who wrote Hamlet, again?", [1]),
        ("They ask who wrote Hamlets", []),
        ("Peter buys 7 apples in Oslo.", [2]),
        ("He said: \u201cAnna buys 9 apples in Bonn\u201d", [2]),
        ("first line\n\nAnna buys 9 apples in Bonn", [2]),
        ("Peter buys 7 pears in Oslo.", []),
        ("maria buys 12 apples in Rome", [2]),  # as before: the first word literally
        ("So Peter's brother carried 7 kg of flour home", [3]),
        ("yes", [4]),
        ("yes and no", []),
        ("pages 3-7 of it are missing from the book", [5]),
        ("+ =", []),
        ("So they said. Pages 3-7 of it are missing from the book", [5]),  # a sentence begins here, though not in the item
        ("Peter buys seven apples in Oslo.", [2]),
        ("So Peter's brother carried seven kg of flour home", [3]),
    ]
    docs = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r._id: r["items"] for r in decontamination.hits(docs, bench).collect()}
    for k, (x, want) in enumerate(cases):
        assert got.get(k, []) == want, x


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header class="site-header">Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, really.</div>%s<div id="sidebar"><p>Popular posts, and more, and more.</p></div>
<form><input name=q><button>Go</button></form><div class="comments"><p>First, I say, great.</p></div><footer>&copy; Us &middot; all</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Big&nbsp;title</h1><p>One, two &amp; three.<br>Four<p><b>Five  six</b>seven.</article>", "Big title One, two & three. Four Five sixseven."),
        ("<div class=content><p>One, two, three, and a good deal of further text.</p><ul><li>a</li><li>b</li></ul><table><tr><td>c<td>d</table></div>", "One, two, three, and a good deal of further text. a b c d"),
        ("<main><!-- note --><p>A &lt;tag&gt; &#233;&#x41;</p><aside>Not this.</aside><script>no()</script><div class='ad'>Buy</div><p>End.</main>", "A <tag> éA End."),
        ("<article><p>Cut off in the middle, as pages are", "Cut off in the middle, as pages are Popular posts, and more, and more."[:35]),
    ],
)
def test_html(body, text):
    if "Cut off" in body:
        assert htmltext.extracted(PAGE.partition("%s")[0] + body) == text
    else:
        assert htmltext.extracted(PAGE % body) == text


@pytest.mark.parametrize("opening", ["<div class='content-sidebar-wrap'>", "<div class='has-sidebar content'>", "<div class='social'><article>", "<div class='tags'>"])
def test_html_article_inside_an_unwanted_class(opening):
    said = "A long article, with commas, and much to say about one thing or another. " * 8
    page = f"<body><div class='sidebar'><p>Popular, posts.</p></div>{opening}<p>{said}</p>{'</article>' if 'article' in opening else ''}</div></body>"
    assert said.strip() in htmltext.extracted(page)
    if "tags" not in opening:
        assert htmltext.extracted(page) == said.strip()


PROSE = "".join(f"<p>Paragraph {k} has prose, with commas, and it goes on for more than a hundred characters, as those of articles do.</p>" for k in "abcd")
SAID = " ".join(re.findall("<p>(.*?)</p>", PROSE))
SHARED = "This paragraph about sharing is prose, and it goes on for long enough to be one of them, surely."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content-area no-sidebar'>{PROSE}</div>", SAID),
        (f"<div class='post comments-open'>{PROSE}</div>", SAID),
        (f"<form id='aspnetForm'><div>{PROSE}</div><input></form>", SAID),
        (f"<article><div class='legal'>{PROSE}</div></article>", SAID),
        (f"<article><h1 class='entry-header'>Title</h1>{PROSE}<p class='share'>{SHARED}</p></article>", f"Title {SAID} {SHARED}"),
        (f"<h1>Title</h1><div class='content'>{PROSE}</div>", f"Title {SAID}"),
        (f"<div><section><h2>One</h2><p>Short.</p></section><section>{PROSE}</section><section><p>End.</p></section></div>", f"One Short. {SAID} End."),
        (f"<div>Loose text here <div>{PROSE}</div> and behind.</div>", f"Loose text here {SAID} and behind."),
        (f"<div><div class='menu'><a>Home</a></div><div>{PROSE}</div><div class='comments'><p>{'Nice one, thanks, really. ' * 40}</p></div></div><div class='sidebar'><p>{'Side text, blah. ' * 10}</p></div>", SAID),
        (f"<ul><li><a>Home</a></li><li><a>News</a></li></ul><div>{PROSE}</div><ul><li><a>One</a></li><li><a>Two</a></li></ul>", SAID),
        ("<div class='ad'>A long advert, with many words, on a page of hardly any.</div><article><h1>Ah.</h1></article>", "Ah."),
        (f"<div class='sidebar'>{PROSE}</div>", SAID),
    ],
)
def test_html_marks_against_the_page(page, text):
    assert htmltext.extracted(f"<body><nav><a>x</a></nav>{page}</body>") == text


def test_html_of_hostile_markup():
    """A megabyte of markup that never closes takes seconds, not hours."""
    began = time.time()
    for piece in ("<a ", '<a "', "<div><p>", "<span>", "<!--", "<", "<script>", "<a \"><b'", "<ul><li>", "<i></b>", "<div class=ad>", "<p>x"):
        htmltext.extracted(piece * (200_000 // len(piece)))
    assert time.time() - began < 30
    assert htmltext.extracted("<div>" * 20_000 + "deep") == "deep"
    assert htmltext.extracted("<i>" * 20_000 + "deep" + "</b>" * 20_000) == "deep"
    assert htmltext.extracted("<p>One <a title=\"never closed>two</a> three<p>four") == "One two three four"


def test_html_table(spark, sf_dir):
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.main_text(pages).collect()}
    for i, html in rows(pages, "page_id", "html"):
        inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        want = " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
        assert got[i] == (want, len(want)), i
    odd = spark.createDataFrame([(1, None, "u", "x"), (2, "", None, "x"), (2, "", None, "x"), (None, "<p>a", "u", "x"), (3, "no tags, at &bogus; all <", "u", "x"), (4, "<" * 3000 + "<div>" * 3000 + "deep", "u", "x")], "page_id long, html string, url string, text string")
    got = [(r.page_id, r.text) for r in htmltext.main_text(odd).collect()]
    same(got, [(1, ""), (2, ""), (2, ""), (None, "a"), (3, "no tags, at &bogus; all <"), (4, "<" * 3000 + " deep")])
    assert htmltext.main_text(odd.limit(0)).count() == 0
