"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased word characters.  Every window of MIN_MATCH tokens of a benchmark
item is a seed; documents are scanned with a rolling Karp-Rabin hash of the same length and
joined to the items on it.  For each (document, item) that shares a seed, seeds on one
diagonal are run together into maximal matches (compared token by token, so a hash collision
does no harm), and the longest match whose tokens are unmarked on both sides is marked,
again and again, down to MIN_MATCH tokens.  Tiles may lie in any order, so a reordered
passage counts like an intact one.  Coverage is the share of the item's tokens under tiles;
from MIN_COVERAGE on the document holds the item.

The benchmark is a stated query set: it goes to the executors in blocks of about
BLOCK_TOKENS tokens, one pass over the documents for each block and a cut between them, so an
executor holds one block, whatever the benchmark's size.

Defined results: null and empty texts match nothing; items of fewer than MIN_MATCH tokens
cannot be told from chance and match nothing; null items are ignored; ties between equally
long matches go to the first in the document, then in the item; repeated rows and repeated
items are treated each on its own; very long texts are scanned whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_text, table

MIN_MATCH = 5
MIN_COVERAGE = 0.5
BLOCK_TOKENS = 4_000_000
TOKENS = re.compile(r"\w+")
FILTER_BITS = 20
#: Seeds of a text and its items held at a time, in four arrays of eight bytes.
SEEDS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
MATCHES = "array<struct<item_id:long,coverage:double,tiles:int,longest:int>>"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())]))


def tokens(text: str) -> list[str]:
    return TOKENS.findall(text.lower())


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``length`` ids."""
    x = ids.astype(np.uint64) * _ODD
    x ^= x >> np.uint64(31)
    n = max(0, len(ids) - length + 1)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = h * _BASE + x[k : k + n]
    return h ^ (h >> np.uint64(32))


class Benchmark:
    """One block of items with its seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.word: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            ids = np.array([self.word.setdefault(w, len(self.word) + 1) for w in tokens(text)], np.int64)
            if len(ids) >= MIN_MATCH:
                self.items.append((item_id, ids))
        parts = [(rolling(ids, MIN_MATCH), i) for i, (_, ids) in enumerate(self.items)]
        h = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(p), i, np.int64) for p, i in parts]) if parts else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(p)) for p, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.seed, self.owner, self.at = h[order], owner[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[h >> np.uint64(64 - FILTER_BITS)] = True

    def runs_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item number, position, item position, length) of the runs of seeds on one diagonal in ``ids``; 0 stands for words of no item.

        Seeds are formed SEEDS at a time and joined at once, since repeated words give as many as the product of their positions.
        """
        h = rolling(ids, MIN_MATCH)
        alien = np.concatenate([[0], np.cumsum(ids == 0)])
        own = (alien[MIN_MATCH:] == alien[: len(alien) - MIN_MATCH]) if len(h) else np.zeros(0, bool)
        pos = np.flatnonzero(own)
        pos = pos[self.filter[h[pos] >> np.uint64(64 - FILTER_BITS)]]
        lo, hi = np.searchsorted(self.seed, h[pos], "left"), np.searchsorted(self.seed, h[pos], "right")
        ends = np.cumsum(hi - lo)
        found, i = [tuple(np.zeros(0, np.int64) for _ in range(4))], 0
        while i < len(pos):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SEEDS, "right")))
            n = hi[i:j] - lo[i:j]
            k = np.repeat(lo[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(joined(self.owner[k], np.repeat(pos[i:j], n), self.at[k], np.ones(len(k), np.int64)))
            i = j
        return joined(*map(np.concatenate, zip(*found)))


def joined(owner: np.ndarray, pos: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of seeds with those that continue each other on a diagonal put together."""
    order = np.lexsort((pos, pos - at, owner))
    owner, pos, at, length = owner[order], pos[order], at[order], length[order]
    new = np.ones(len(pos), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (pos[1:] - at[1:] != pos[:-1] - at[:-1]) | (pos[1:] != pos[:-1] + length[:-1])
    first = np.flatnonzero(new)
    return owner[first], pos[first], at[first], np.add.reduceat(length, first) if len(first) else length


def tile(doc: np.ndarray, item: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length) grown from runs of seeds (position, item position, seeds)."""
    matches = set()
    for p, q, n in runs:
        n += MIN_MATCH - 1
        same = doc[p : p + n] == item[q : q + n]
        if same.all():
            matches.add((p, q, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        matches |= {(p + int(x), q + int(x), int(y - x)) for x, y in zip(edges[::2], edges[1::2]) if y - x >= MIN_MATCH}
    base = min((p for p, _, _ in matches), default=0)
    doc_free = np.ones(max((p + n for p, _, n in matches), default=0) - base, bool)
    item_free = np.ones(len(item), bool)
    tiles, left = [], len(item)
    heap = [(-n, p, q) for p, q, n in matches]
    heapq.heapify(heap)
    while heap and left >= MIN_MATCH:
        n, p, q = heapq.heappop(heap)
        n = -n
        free = item_free[q : q + n] & doc_free[p - base : p - base + n]
        if free.all():
            tiles.append((p, q, n))
            item_free[q : q + n] = doc_free[p - base : p - base + n] = False
            left -= n
            continue
        # what is left of the match goes back among the others
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x >= MIN_MATCH:
                heapq.heappush(heap, (-(y - x), p + x, q + x))
    return tiles


def match(texts: list[str | None], bench: Benchmark, min_coverage: float) -> list[list[dict]]:
    """Items that each text holds."""
    get, parts, starts, n = bench.word.get, [], [0], 0
    for text in texts:
        words = tokens(text or "")
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        parts += [ids, np.zeros(1, np.int64)]  # no window crosses a text
        n += len(ids) + 1
        starts.append(n)
    found: list[list[dict]] = [[] for _ in texts]
    if not bench.items or not parts:
        return found
    ids, bounds = np.concatenate(parts), np.array(starts)
    owner, pos, at, length = bench.runs_of(ids)
    row = np.searchsorted(bounds, pos, "right") - 1
    order = np.lexsort((pos, owner, row))
    pos, owner, at, length, row = pos[order], owner[order], at[order], length[order], row[order]
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])])) if len(pos) else []
    for a, b in zip(cut, np.append(cut[1:], len(pos)).astype(np.int64)):
        item_id, item = bench.items[owner[a]]
        ends = np.zeros(len(item) + 1, np.int64)
        np.add.at(ends, at[a:b], 1)
        np.add.at(ends, at[a:b] + length[a:b] + MIN_MATCH - 1, -1)
        if (np.cumsum(ends) > 0).sum() < min_coverage * len(item):
            continue  # all seeds together don't cover enough
        base = bounds[row[a]]
        tiles = tile(ids[base : bounds[row[a] + 1]], item, list(zip((pos[a:b] - base).tolist(), at[a:b].tolist(), length[a:b].tolist())))
        covered = sum(k for _, _, k in tiles) / len(item)
        if covered and covered >= min_coverage:
            found[row[a]].append({"item_id": item_id, "coverage": covered, "tiles": len(tiles), "longest": max(k for _, _, k in tiles)})
    return found


def blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """Items, about ``block_tokens`` tokens at a time, and whether they are the last."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // (6 * block_tokens)
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield b == n - 1, sorted((r["item_id"], r["text"]) for r in part.collect())


def with_matches(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, name: str = "bench_matches", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` with a column ``name`` of the items each document holds, which replaces one of that name; no shuffle.

    Between blocks the table is cut, so that an executor holds one block at a time.
    """
    others = [f for f in docs.schema.fields if f.name != name]
    out = docs.select(*[f"`{f.name}`" for f in others]).withColumn(name, F.array().cast(MATCHES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + f", `{name}` {MATCHES}"
    for last, block in blocks(benchmark, block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        made: dict[int, Benchmark] = {}

        def run(batch: pa.RecordBatch, shared=shared, made=made) -> pa.RecordBatch:
            if 0 not in made:
                made[0] = Benchmark(shared.value)
            new = match(batch.column("text").to_pylist(), made[0], min_coverage)
            old = batch.column(name).to_pylist()
            both = pa.array([a + b for a, b in zip(old, new)], _MATCH_TYPE)
            names = batch.schema.names
            return pa.RecordBatch.from_arrays([batch.column(c) if c != name else both for c in names], names=names)

        out = map_text(out, run, schema)
        if not last:
            out = checkpointed(out)
            shared.unpersist()
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (document, benchmark item) that the document holds."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = with_matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("bench_matches").alias("m"))
    return pairs.select("doc_id", "m.item_id", "m.coverage", F.col("m.tiles").cast("long").alias("tiles"), F.col("m.longest").cast("long").alias("longest"))
