"""URL filters over a sorted digest array.

The list (rules `host/path`, each with a verdict) is kept in one file: the
64-bit xxhash of every entry, sorted, then where its text begins, its verdict,
and the texts themselves. It is
written to the shared folder and Spark hands it to each executor once; a worker
maps it into memory, so that its pages are shared and a list larger than a
worker's heap can still be probed.

A url is probed with each suffix of its host that begins at a label, joined to
each prefix of its path that is as long as some entry's path. All probes of a
batch go through one vectorised binary search; where a key is found, the
stored text must equal the probe, so that a collision of digests never
decides. The longest entry that fits wins (on a tie the one with the longer
host). A url that no entry fits gets `default`: it isn't on the list.

The host is what follows the first ://, up to /, ? or # or the end, with A-Z
in lower case; the path goes on up to ? or # or the end, unchanged. Null urls and those
without :// have both empty and get the default. Rows are judged one by one,
repeated ones alike; an empty list gives every url the default; an empty table
gives no rows. A very long host or path costs no more probes than the list has
lengths: suffixes longer than the longest listed host and prefixes that no
entry's path has aren't probed. Only the two columns that are named are read.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from prismal.session import put, ship

#: The rules of the query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HEAD = struct.Struct("<QQQ")


def packed(rules) -> bytes:
    """The file's bytes: counts, the longest host, path lengths, keys, text offsets, verdicts, texts. A rule given twice must have one verdict."""
    table: dict[bytes, bool] = {}
    for host, path, verdict in rules:
        text = (host.translate(_LOWER) + path).encode()
        if table.setdefault(text, verdict == "block") != (verdict == "block"):
            raise ValueError(f"{host}{path} is both allowed and blocked")
    order = sorted(table, key=lambda t: (xxhash.xxh64_intdigest(t), t))
    lengths = np.array(sorted({len(path) for _, path, _ in rules}), np.int64)
    ends = np.cumsum([0, *map(len, order)], dtype=np.int64)
    keys = np.array([xxhash.xxh64_intdigest(t) for t in order], np.uint64)
    verdicts = np.array([table[t] for t in order], np.uint8)
    longest = max((len(host) for host, _, _ in rules), default=0)
    return b"".join([_HEAD.pack(len(order), len(lengths), longest), lengths.tobytes(), keys.tobytes(), ends.tobytes(), verdicts.tobytes(), *order])


class DigestArray:
    """A mapped file of packed()."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n, m, self.longest = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        at = _HEAD.size
        self.lengths = raw[at : at + 8 * m].view(np.int64)
        at += 8 * m
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.blocks = raw[at : at + n]
        self.texts = raw[at + n :]

    def find(self, probes: list[bytes], digests: np.ndarray) -> np.ndarray:
        """The entry of each probe, or -1."""
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys) or not probes:
            return out
        place = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero((place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == digests)):
            k = int(place[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:  # entries with one digest stand together
                if self.texts[self.ends[k] : self.ends[k + 1]].tobytes() == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out


def _handed(spark: SparkSession, data: bytes) -> str:
    """Write the file into the shared folder, under a name of its content, and have Spark hand it to every executor."""
    name = f"digests-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    spark.sparkContext.addFile(put(spark, name, data))
    return name


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host, rest[:end]


def _suffixes(host: str, longest: int):
    """The host and what follows each of its dots, up to a length."""
    if len(host) <= longest:
        yield host
    at = host.find(".", max(0, len(host) - longest - 1))
    while at >= 0:
        yield host[at + 1 :]
        at = host.find(".", at + 1)


def filtered(pages: DataFrame, rules=RULES, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    ship(spark)
    name = _handed(spark, packed(rules))

    def run(batches):
        array = _mapped(name)
        lengths = [int(n) for n in array.lengths]
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).to_pylist()]
            probes, owner, hosts = [], [], []
            for i, (host, path) in enumerate(urls):
                if not host:
                    continue
                for suffix in _suffixes(host, array.longest):
                    for n in lengths:
                        if n <= len(path):
                            probes.append((suffix + path[:n]).encode())
                            owner.append(i)
                            hosts.append(len(suffix))
            digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
            best: list[tuple[int, int, str, str] | None] = [None] * len(urls)
            found = array.find(probes, digests)
            for k in np.flatnonzero(found >= 0):
                text = probes[k].decode()
                new = (len(text), hosts[k], text, "block" if array.blocks[found[k]] else "allow")
                if best[owner[k]] is None or new > best[owner[k]]:
                    best[owner[k]] = new
            columns = [batch.column(0).cast(pa.int64()), pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()), pa.array([b and b[2] for b in best], pa.string()), pa.array([b[3] if b else default for b in best], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(id_col, url_col).mapInArrow(run, SCHEMA)


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))


HOST = r"CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
PATH = r"CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
ORACLE = f"""
WITH u AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages),
r(rhost, rpath, verdict) AS (VALUES {', '.join(map(str, RULES))}),
m AS (
  SELECT u.page_id, u.host, u.path, rhost || rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
