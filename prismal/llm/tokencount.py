"""Token counts by a linear longest-match automaton.

The greedy longest-match split of a word into vocabulary pieces is counted
without building the pieces. The vocabulary is a trie over bytes. Each node
has a failure link and the number of pieces that following it pops: when the
node has no child for the next byte, the longest piece at its start is split
off (and perhaps more), and reading goes on at the node of what is left. Both
are computed once, in order of depth, so that a word costs time linear in its
bytes (the LinMaxMatch construction of Song et al., 2021).

The vocabulary is that of a public byte-level tokenizer, read by the driver from
a path that is a parameter, put into the shared folder and handed to every
executor; its first pieces carry a leading blank, so that a word is
matched as blank + word. It holds all single bytes: every word has a split.

All different words of an Arrow batch advance together, a byte a step, over
flat arrays; words beyond LONG bytes are walked one by one. Memory is bounded
by the batch. Null and empty texts have no words and no tokens; rows are
counted one by one, whatever their id, so that repeated rows agree; an empty
table gives no rows. Other columns are left alone, but those named n_words and
n_tokens, which the results replace.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import steps, token_table
from prismal.session import put, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG = 512


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file of lines `base64 rank`."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    """Trie with failure links. Node 0 is the root; children are found by one binary search over node * 256 + byte."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.child: dict[int, int] = {}
        depth, final = [0], [False]
        above: list[tuple[int, int]] = [(0, 0)]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if (below := self.child.get(key)) is None:
                    below = self.child[key] = len(depth)
                    depth.append(depth[node] + 1)
                    final.append(False)
                    above.append((node, byte))
                node = below
            final[node] = node > 0
        if missing := [b for b in range(256) if b not in self.child or not final[self.child[b]]]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        n = len(depth)
        self.fail, self.pops = [0] * n, [0] * n
        below_of: list[list[int]] = [[] for _ in range(n)]
        for key, node in self.child.items():
            below_of[key >> 8].append(node)
        queue = deque(below_of[0])
        while queue:
            node = queue.popleft()
            queue.extend(below_of[node])
            parent, byte = above[node]
            if final[node]:  # the whole node is a piece: nothing is left
                self.fail[node], self.pops[node] = 0, 1
                continue
            at, popped = self.fail[parent], self.pops[parent]
            while (to := self.child.get(at << 8 | byte)) is None:
                popped += self.pops[at]
                at = self.fail[at]
            self.fail[node], self.pops[node] = to, popped
        self.keys = np.array(sorted(self.child), np.int64)
        self.to = np.array([self.child[int(k)] for k in self.keys], np.int64)
        self.fails, self.popped = np.array(self.fail, np.int64), np.array(self.pops, np.int64)

    def count_one(self, word: bytes) -> int:
        child, fail, pops, at, n = self.child, self.fail, self.pops, 0, 0
        for byte in word:
            while (to := child.get(at << 8 | byte)) is None:
                n += pops[at]
                at = fail[at]
            at = to
        while at:
            n += pops[at]
            at = fail[at]
        return n

    def count(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Pieces of each blank + word, the words given as slices of `data`."""
        at = np.full(len(begin), self.child[32], np.int64)
        n = np.zeros(len(begin), np.int64)
        order = np.argsort(-length, kind="stable")
        live = order[length[order] > 0]
        for step in range(int(length.max(initial=0))):
            live = live[: np.searchsorted(-length[live], -step, side="left")]  # longest first
            byte = data[begin[live] + step].astype(np.int64)
            todo = live
            while len(todo):
                key = at[todo] << 8 | byte
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                at[todo[hit]] = self.to[place[hit]]
                todo, byte = todo[~hit], byte[~hit]
                n[todo] += self.popped[at[todo]]
                at[todo] = self.fails[at[todo]]
        live = np.flatnonzero(at)
        while len(live):
            n[live] += self.popped[at[live]]
            at[live] = self.fails[at[live]]
            live = live[at[live] > 0]
        return n


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """One a Python worker."""
    return Automaton(read_vocabulary(path))


def word_lengths(machine: Automaton, distinct: pa.Array) -> np.ndarray:
    """Pieces of each distinct word."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    distinct = pa.concat_arrays([distinct.cast(pa.binary())])
    ends = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
    data = np.frombuffer(distinct.buffers()[2], np.uint8)
    length = np.diff(ends)
    short = length <= LONG
    out = np.zeros(len(distinct), np.int64)
    out[short] = machine.count(data, ends[:-1][short], length[short])
    for i in np.flatnonzero(~short):
        out[i] = machine.count_one(b" " + data[ends[i] : ends[i + 1]].tobytes())
    return out


def counted(docs: DataFrame, *, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """docs with n_words and n_tokens in place of the text."""
    spark = docs.sparkSession
    ship(spark)
    data = Path(vocabulary).read_bytes()
    name = f"vocabulary-{hashlib.sha256(data).hexdigest()[:24]}"
    spark.sparkContext.addFile(put(spark, name, data))
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "n_tokens")]
    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches):
        machine = automaton(SparkFiles.get(name))
        for whole in batches:
            for batch in steps(whole, text_col):
                offsets, word, distinct = token_table(batch.column(batch.schema.get_field_index(text_col)))
                total = np.zeros(len(word) + 1, np.int64)
                np.cumsum(word_lengths(machine, distinct)[word], out=total[1:])
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets]))], names=schema.names)

    return docs.mapInArrow(run, schema)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
