"""SimHash near-duplicates, compared bit-sliced.

A fingerprint has 64 bits.  Fingerprints within ``radius`` bits agree on at least ``keep`` of ``radius + keep`` bit
blocks, so distinct fingerprints are dealt once per choice of ``keep`` blocks, by the value of those blocks.  ``keep``
follows the number of fingerprints, which keeps the usual bucket small at any size; every choice finds the same links.
A bucket of more than ``CHUNK`` members is cut into chunks and every pair of chunks becomes a cell of its own.

Inside a cell, fingerprints lie as bit planes: 64 members to a word, one word per bit position.  A query is compared with
64 members at once by exclusive-or with its bit, two planes to a carry-save step; a block of members is left as soon
as all of its distances have passed the radius.  A cell hands on a forest of its links and not all pairs.

Defined cases: a null text is an empty text, whose fingerprint is zero and links like any other; a null key is never the
name of a component unless all its keys are null; repeated rows each get their row; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ticktape.llm import components
from ticktape.llm.tables import text_of, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Members of a bucket that are compared in one task.
CHUNK = 2048
#: The mean bucket above which fingerprints are dealt by one more block.
FULL_BUCKET = 4096
#: Comparisons of a query with a word of members that are worked on at once.
SLICE = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    line = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):  # memory stays bounded for very long texts
        hashes = b"".join([digest(line[i:j], SEED) for i, j in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprint_udf(shingle: int = SHINGLE):
    """The fingerprint as a signed 64-bit column."""

    @pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            marks = np.fromiter((fingerprint(t, shingle) for t in batch), np.uint64, len(batch))
            yield pd.Series(marks.view(np.int64))

    return simhash


def block_masks(radius: int, keep: int) -> list[int]:
    """Masks of every choice of ``keep`` among ``radius + keep`` blocks of the 64 bits."""
    n = radius + keep
    edges = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(blocks, keep)]


def blocks_to_keep(fingerprints: int, radius: int) -> int:
    keep = 1
    while fingerprints / 2 ** (64 * keep / (radius + keep)) > FULL_BUCKET:
        keep += 1
    return keep


# --- bit-sliced comparison -------------------------------------------------------------------------------------


def _planes(marks: np.ndarray, words: np.ndarray, lanes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertical bit planes [64, n_words] and the mask of lanes that hold a member."""
    padded = np.zeros(n_words * 64, np.uint64)
    held = np.zeros(n_words * 64, np.uint8)
    padded[words * 64 + lanes] = marks
    held[words * 64 + lanes] = 1
    pack = lambda bits: np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    planes = np.stack([pack(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(64)])
    return planes, pack(held)


def _within(planes: np.ndarray, marks: np.ndarray, words: np.ndarray, held: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For every (query, word): which of the word's 64 members are within ``radius``.  Returns the places in the
    list that hold any, and their lanes as words."""
    depth = (radius + 1).bit_length()
    at = np.arange(len(marks))
    counters = [np.zeros(len(marks), np.uint64) for _ in range(depth)]
    gone = ~held[words]
    for b in range(0, 64, 2):
        low, high = (
            planes[bit][words] ^ (np.uint64(0) - ((marks >> np.uint64(bit)) & np.uint64(1))) for bit in (b, b + 1)
        )
        # carry-save: counter plane 0 and two new planes make one sum and one carry
        mixed = low ^ high
        carry = (low & high) | (counters[0] & mixed)
        counters[0] = counters[0] ^ mixed
        for k in range(1, depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        gone = gone | carry
        if b % 8 == 6:
            over, same = np.zeros(len(at), np.uint64), ~np.zeros(len(at), np.uint64)
            for k in reversed(range(depth)):  # counter > radius, from the highest plane down
                if radius >> k & 1:
                    same = same & counters[k]
                else:
                    over, same = over | (same & counters[k]), same & ~counters[k]
            gone = gone | over
            alive = np.flatnonzero(gone != np.uint64(0xFFFFFFFFFFFFFFFF))
            if len(alive) < len(at):  # blocks whose members have all passed the radius are left
                at, marks, words, gone = at[alive], marks[alive], words[alive], gone[alive]
                counters = [c[alive] for c in counters]
            if not len(at):
                break
    return at, ~gone


class _Forest:
    """Union by smallest place, over whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = np.flatnonzero(ra != rb)
            if not len(apart):
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def cell_links(cells: np.ndarray, sides: np.ndarray, marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of equal ``cells`` (sorted, with ``sides``), as (member, root) pairs of a forest.

    A cell with one side compares its members with each other; one with two sides, its first with its second.
    """
    n = len(marks)
    if n < 2:
        return marks[:0], marks[:0]
    runs = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])])
    sizes = np.diff(np.r_[runs, n])
    n_words = -(-sizes // 64)
    first_word = np.r_[0, np.cumsum(n_words)]
    run_of = np.repeat(np.arange(len(runs)), sizes)
    place = np.arange(n) - runs[run_of]
    planes, held = _planes(marks, first_word[run_of] + place // 64, place % 64, int(first_word[-1]))
    member = np.full(int(first_word[-1]) * 64, -1)
    member[(first_word[run_of] + place // 64) * 64 + place % 64] = np.arange(n)
    # every member queries the words of its own run from its own word on, or all words of the other side
    two = np.zeros(len(runs), bool)
    if len(runs) > 1:
        two[:-1] = cells[runs[1:]] == cells[runs[:-1]]
    answered = np.zeros(len(runs), bool)
    answered[1:] = two[:-1]
    start = np.where(two[run_of], first_word[np.minimum(run_of + 1, len(runs) - 1)], first_word[run_of] + place // 64)
    stop = np.where(two[run_of], first_word[np.minimum(run_of + 2, len(runs))], first_word[run_of + 1])
    stop = np.where(answered[run_of] | (sizes[run_of] < 2) & ~two[run_of], start, stop)
    forest, upto, i = _Forest(n), np.cumsum(stop - start), 0
    while i < n:
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + SLICE, "right")))
        span = (stop - start)[i:j]
        query = np.repeat(np.arange(i, j), span)
        words = np.repeat(start[i:j] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        i = j
        if not len(query):
            continue
        at, lanes = _within(planes, marks[query], words, held, radius)
        bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        forest.add(query[at[row]], member[words[at[row]] * 64 + lane])
    linked = np.flatnonzero(forest.root != np.arange(n))
    return marks[linked], marks[forest.root[linked]]


def _linker(radius: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cells = held["cell"].to_numpy()
            whole = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on in the next batch
            if whole:
                yield _links_of(held.iloc[:whole], radius)
                held = held.iloc[whole:]
        if held is not None:
            yield _links_of(held, radius)

    return link


def _links_of(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    cells = rows[["cell", "table", "key", "i", "j"]].to_numpy()
    changed = np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)].cumsum()
    a, b = cell_links(changed, rows["side"].to_numpy(), rows["mark"].to_numpy().view(np.uint64), radius)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(marks: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """A forest of links per cell between distinct fingerprints (column ``mark``); together they connect all that
    lie within ``radius``."""
    keep = blocks_to_keep(marks.count(), radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = F.array(*[F.struct(F.lit(t).alias("table"), F.col("mark").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for t, m in enumerate(block_masks(radius, keep))])
    dealt = marks.select("mark", F.explode(choices).alias("c")).select("mark", "c.table", "c.key")
    crowded = dealt.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).drop("n")
    placed = dealt.join(crowded, ["table", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int")
    spread = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = spread.select(
        "mark", "table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    ).withColumn("cell", F.xxhash64("table", "key", "i", "j"))
    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell", "table", "key", "i", "j", "side")
    return sorted_cells.mapInPandas(_linker(radius), "a long, b long")


def classes(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``mark`` and ``smallest``: for every fingerprint the least ``smallest`` of those reachable over links."""
    nodes = marks.groupBy("mark").agg(F.min("smallest").alias("smallest"))
    nodes = written(nodes, "marks")
    roots = components.roots(links(nodes.select("mark"), radius))
    return components.smallest_in_class(nodes.withColumnRenamed("mark", "node"), roots).withColumnRenamed("node", "mark")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the key, its ``fingerprint`` (signed 64 bits) and ``component_id``, the smallest key reachable."""
    marks = written(docs.select(F.col(key).alias("key"), fingerprint_udf(shingle)(text_of(text)).alias("mark")), "simhash")
    named = classes(marks.withColumn("smallest", F.col("key")), radius)
    return marks.join(named, "mark").select(F.col("key").alias(key), F.col("mark").alias("fingerprint"), F.col("smallest").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component is kept: the one of the smallest key."""
    ident = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.xxhash64(text_of(text)).alias("same"))
    marks = written(docs.select(ident.alias("smallest"), fingerprint_udf(shingle)(text_of(text)).alias("mark")), "simhash")
    # three plain columns: a struct of other nullability would be cast, and dealt out once more
    place = lambda i: [i["no_key"].alias("no_key"), F.coalesce(i["key"].cast("string"), F.lit("")).alias("key"), i["same"].alias("same")]
    columns = ["no_key", "key", "same"]
    kept = classes(marks, radius).select(*place(F.col("smallest"))).distinct()
    rows = docs.select(F.struct("*").alias("row"), *place(ident))
    # repeated rows go where they lie, and what is left of them is dealt out once for both steps
    return rows.dropDuplicates(columns).join(kept, columns, "left_semi").select("row.*")
