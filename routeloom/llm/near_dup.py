"""Near-duplicate documents by SetSketch registers, exact on full shingle sets.

A document's set holds the distinct 5-word shingles of its words (A-Z lower-cased, words are
runs without ASCII white space), as 64-bit hashes; with fewer words the whole sequence is
one shingle.  Documents with one set form a class at once, represented by their smallest id,
so copies cost one row each whatever their number.

Registers.  REGISTERS exponentially distributed minima of the set, on a logarithmic scale
with base BASE and truncated to 0..LIMIT: register values are mergeable by maximum and equal
with about the probability of the Jaccard similarity.  Bands of registers give bucket keys;
their length follows from the least similarity (``level``), so that two documents at it share
no bucket with a probability below 1e-6: 24 bands of 5 at 0.85, 30 of 4 at 0.8.

Links.  Each bucket has a pivot, the member that shares most with others; a group of near
copies so has few pivots in all its bands.  Every member of a bucket is paired with the pivot
once: pairs whose joint maximum likelihood estimate from registers and set sizes allows a link
are verified on their full sets, and the symmetric difference of the two sets is kept.  The
members of a pivot form its cluster, so any two members of one bucket meet in a cluster.
Where a cluster still holds several components, its members are compared pack by pack inside
one task: the estimate first, then the exact similarity from the differences alone, since
X ^ Y = (X ^ P) ^ (Y ^ P).  Two packs meet only if the sizes of their sets and differences allow
a link and they aren't of one and the same component; a task gives back a spanning forest of
the links that it found, never pairs.  One such pass is complete.  Components come from
alternating large-star and small-star steps.  Nothing is sampled or capped, and nothing but a
Bloom filter of fixed size goes through the driver.  Texts are read twice: for registers, and
for the full sets of those that share a bucket.

Defined results: null text and text without words have an empty set (0 shingles) and are
linked with nothing; rows that repeat an id share its class; very long texts are cut into
blocks for hashing only; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_text, release, table

SHINGLE = 5
PARTS = 100
REGISTERS = 120
MISS = 1e-6
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Rows of an id table, and of a register table, for one task: small tables don't spread over all shuffle partitions.
ID_ROWS, REGISTER_ROWS = 250_000, 20_000
#: Members, and elements of their differences, in one pack: two packs are compared in one task (4 MB of elements).
CHUNK, CHUNK_ELEMENTS = 512, 1 << 18
#: Members that meet one copy of their pivot's set.
SALT = 2048
#: Bits of the Bloom filter: eight for each id, from 2 ** 20 to 2 ** 30 (128 MB); past that more rows pass, and the joins behind it stay exact.
BLOOM_LEAST, BLOOM_MOST = 20, 30
#: Bytes of text hashed at a time; some fifteen arrays of eight bytes for each stand beside it.
BLOCK = 1 << 20
U64 = np.uint64
_M = U64(0xD6E8FEB86659FD93)
_M_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1 << 31, 1 << 32, (2, REGISTERS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_S = _rng.integers(0, 1 << 32, (2, REGISTERS), dtype=np.uint64).astype(np.uint32)


class Level(NamedTuple):
    """What follows from the least similarity, ``least`` hundredths: link when 100 * intersection >= least * union."""

    least: int
    #: bands * band_rows = REGISTERS.
    bands: int
    band_rows: int
    #: Pairs whose likelihood estimate is below this lie six standard deviations under the least similarity.
    least_estimate: float
    #: Equal registers below which an estimate isn't worth its time; far fewer than least_estimate gives.
    few_equal: int


@cache
def level(least: int) -> Level:
    """The longest bands in which two documents at the least similarity share no bucket with a probability below MISS."""
    if not 30 <= least <= 100:
        raise ValueError("the least similarity must be 30 to 100 hundredths")
    j = least / 100
    rows = max(r for r in range(1, REGISTERS + 1) if REGISTERS % r == 0 and (1 - j**r) ** (REGISTERS // r) < MISS)
    estimate_ = math.floor(100 * (j - 6 * math.sqrt(j * (1 - j) / REGISTERS)) + 1e-9) / 100
    return Level(least, REGISTERS // rows, rows, estimate_, max(1, math.floor(REGISTERS * (estimate_ - 0.15) + 1e-9)))


#: Of op8.
CONTRACT = level(85)
LEAST_ESTIMATE = CONTRACT.least_estimate


def compact(df: DataFrame, rows_per_task: int = ID_ROWS) -> tuple[DataFrame, int]:
    """The table behind a lineage cut, in as many partitions as its rows need, and that number."""
    cut = checkpointed(df)
    n = 1 + cut.count() // rows_per_task
    return cut.coalesce(n), n


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def _block_powers(base: int) -> np.ndarray:
    x = np.full(BLOCK, base, U64)
    x[0] = 1
    return np.cumprod(x, dtype=U64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if n <= BLOCK:
        return _block_powers(base)[:n]
    x = np.full(n, base, U64)
    x[0] = 1
    return np.cumprod(x, dtype=U64)


def _blocks(raw: bytes) -> Iterator[bytes]:
    """Pieces of about BLOCK bytes that end at white space; a word longer than that stays whole."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            cut = max(raw.rfind(bytes([c]), at, end) for c in (32, 10, 9, 13, 11, 12))
            if cut <= at:
                after = [x for c in (32, 10, 9, 13, 11, 12) if (x := raw.find(bytes([c]), end)) >= 0]
                cut = min(after, default=n)
            end = cut
        yield raw[at:end]
        at = end


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ASCII-lower-cased UTF-8 bytes."""
    hashes, starts, base = [], [], 0
    for block in _blocks(raw):
        x = np.frombuffer(block, np.uint8)
        word = (x != 32) & ((x < 9) | (x > 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, U64), np.cumsum((x.astype(U64) + U64(1)) * powers(int(_M), len(x)), dtype=U64)])
        hashes.append(mix((total[b] - total[a]) * powers(int(_M_INVERSE), len(x))[a] + (b - a).astype(U64)))
        starts.append(a + base)
        base += len(block)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    h, start = word_hashes(b"\n".join(raw))
    bounds = np.searchsorted(start, offsets)
    if len(h) >= SHINGLE:
        s = np.zeros(len(h) - SHINGLE + 1, U64)
        for k in range(SHINGLE):
            s = s * _M + h[k : k + len(s)]
        s = mix(s)
    else:
        s = np.zeros(0, U64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= SHINGLE:
            x = np.sort(s[a : b - SHINGLE + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            few = U64(b - a)
            for k in range(a, b):
                few = U64((int(few) * int(_M) + int(h[k])) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([few ^ U64(0x5851F42D4C957F2D)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """Truncated logarithmic minima; the registers of a union are the maxima of the registers."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    lo, hi = (shingles & U64(0xFFFFFFFF)).astype(np.uint32), (shingles >> U64(32)).astype(np.uint32)
    for k in range(0, len(shingles), 4096):
        v = (lo[k : k + 4096, None] ^ _S[0]) * _A[0]
        v += (hi[k : k + 4096, None] ^ _S[1]) * _A[1]
        np.minimum(least, v.min(0), out=least)
    x = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum likelihood of the Jaccard similarity for rows of register pairs and set sizes."""
    up, down = (ka > kb).sum(1)[:, None], (ka < kb).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    pa_, pb = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    like = up * np.log(pa_) + down * np.log(pb) + (ka.shape[1] - up - down) * np.log(np.maximum(1 - pa_ - pb, 1e-12))
    return j[np.arange(len(j)), like.argmax(1)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2 (the set's identity) and regs (bytes) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text").to_pylist())
        k1 = np.array([x.sum(dtype=U64) if len(x) else 0 for x in sets], U64).view(np.int64)
        k2 = np.array([np.bitwise_xor.reduce(mix(x)) if len(x) else 0 for x in sets], U64).view(np.int64)
        regs = [registers(x).tobytes() if len(x) else None for x in sets]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.array(regs, pa.binary())], names=["doc_id", "n", "k1", "k2", "regs"])

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, k1 long, k2 long, regs binary", limit=BLOCK)


def band_rows(reps: DataFrame, at: Level) -> DataFrame:
    """bucket, rep: a row for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, at.bands, at.band_rows).astype(U64)
            key = np.broadcast_to(np.arange(1, at.bands + 1, dtype=U64), regs.shape[:2]).copy()
            for k in range(at.band_rows):
                key = mix(key * _M + regs[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("rep")), at.bands))], names=["bucket", "rep"])

    return reps.select("rep", "regs").mapInArrow(run, "bucket long, rep long")


class Bloom:
    """Bits over ids, a power of two of them; executors build parts, which are merged by or."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(x: np.ndarray, bits: int) -> list[np.ndarray]:
        h = mix(x.astype(np.int64).view(U64))
        return [(h >> U64(17 * k)) & U64(bits - 1) for k in (0, 1, 2)]

    def may_hold(self, ids: pa.Array) -> np.ndarray:
        ok = np.array(ids.is_valid(), bool)
        for p in self.places(np.asarray(ids.fill_null(0)), 64 * len(self.words)):
            ok &= (self.words[p >> U64(6)] >> (p & U64(63))) & U64(1) == 1
        return ok

    @classmethod
    def of(cls, ids: DataFrame) -> Bloom:
        """Of the first column of ``ids``."""
        size = 1 << min(BLOOM_MOST, max(BLOOM_LEAST, (8 * ids.count()).bit_length()))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size // 64, U64)
            for batch in batches:
                for p in cls.places(np.asarray(batch.column("id")), size):
                    np.bitwise_or.at(bits, p >> U64(6), U64(1) << (p & U64(63)))
            found = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(bits[found].view(np.int64))], names=["w", "v"])

        made = ids.select(F.col(ids.columns[0]).alias("id")).where("id is not null").mapInArrow(build, "w int, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # at most size / 64 rows
        words = np.zeros(size // 64, U64)
        words[np.asarray(made.column("w"))] = np.asarray(made.column("v")).view(U64)
        return cls(words)


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``removed``; only rows that pass the filter are shuffled, and only ids go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.of(removed.select("doc_id")))

    @F.arrow_udf("boolean")
    def maybe(ids: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_hold(ids))

    rest = docs.where(maybe("doc_id")).join(removed.select("doc_id").distinct(), "doc_id", "left_anti")
    return docs.where(~maybe("doc_id")).unionByName(rest.select(*[f"`{c}`" for c in docs.columns]))


def may_link(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, at: Level = CONTRACT) -> np.ndarray:
    """Of rows of register pairs and set sizes: whether the estimate allows a link."""
    ok = [estimate(ka[i : i + 2000], kb[i : i + 2000], na[i : i + 2000].astype(float), nb[i : i + 2000].astype(float)) >= at.least_estimate for i in range(0, len(ka), 2000)]
    return np.concatenate(ok) if ok else np.zeros(0, bool)


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, shingles (sorted hashes) of the documents in column rep of ``ids``, and of some more that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.of(ids.select("rep")))

    def to_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(shared.value.may_hold(batch.column("doc_id"))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in shingle_sets(batch.column("text").to_pylist())], pa.binary())], names=["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return checkpointed(map_text(texts, to_sets, "rep long, shingles binary", limit=BLOCK))


def differences(pairs: DataFrame, reps: DataFrame, docs: DataFrame, at: Level) -> DataFrame:
    """pivot, rep, n, regs, d (symmetric difference of the two sets), link of every (pivot, rep)."""
    ids, n = compact(pairs.select("rep").union(pairs.select("pivot")).distinct())
    sets = full_sets(ids, docs).dropDuplicates(["rep"]).join(reps.select("rep", "n", "regs"), "rep")
    salts = F.ceil(F.col("members") / SALT).cast("int")
    members = pairs.join(pairs.groupBy("pivot").agg(F.count("*").alias("members")).coalesce(n), "pivot").withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
    centres = members.select("pivot", "salt").distinct().join(sets.toDF("pivot", "ps", "pn", "pregs"), "pivot")
    both = members.join(sets, "rep").select("pivot", "salt", "rep", "n", "regs", "shingles").join(centres, ["pivot", "salt"]).drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ka, kb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs", "pregs"))
            may = may_link(ka, kb, np.asarray(b.column("n")), np.asarray(b.column("pn")), at)
            apart, ok = [], []
            for x, y, m in zip(b.column("shingles"), b.column("ps"), may):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                d = np.setxor1d(x, y, assume_unique=True)
                both_ = len(x) + len(y) - len(d)  # twice the intersection
                ok.append(bool(m) and both_ * (PARTS + at.least) >= 2 * at.least * (len(x) + len(y)))
                apart.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("rep"), b.column("n"), b.column("regs"), pa.array(apart, pa.binary()), pa.array(ok, pa.bool_())], names=["pivot", "rep", "n", "regs", "d", "link"])
        release()

    return checkpointed(both.mapInArrow(run, "pivot long, rep long, n long, regs binary, d binary, link boolean"))


def shared_counts(da: np.ndarray, la: np.ndarray, db: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """How many elements each set of one side has in common with each of the other; sets are runs of ``la`` (``lb``) elements in ``da`` (``db``)."""
    a, b = len(la), len(lb)
    out, common = np.zeros(a * b, np.int64), np.intersect1d(da, db)
    if not len(common):
        return out.reshape(a, b)

    def entries(d, lengths):
        """Set and column of the elements that both sides have, by column; number of entries and first entry of each column."""
        at = np.searchsorted(common, d)
        hit = common[np.minimum(at, len(common) - 1)] == d
        who, at = np.repeat(np.arange(len(lengths)), lengths)[hit], at[hit]
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=len(common))
        return who[order], at[order], count, np.cumsum(count) - count

    wa, ca, na, fa = entries(da, la)
    wb, cb, nb, _ = entries(db, lb)
    many = na * nb > max(16, a * b // 100)
    few = ~many[cb]
    wf, cf = wb[few], cb[few]
    steps = np.concatenate([[0], np.cumsum(na[cf])])
    at = 0
    while at < len(wf):  # elements of few sets: each pair that shares one, a million pairs at a time
        end = max(at + 1, int(np.searchsorted(steps, steps[at] + (1 << 20), "right")) - 1)
        k = na[cf[at:end]]
        nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out += np.bincount(wa[np.repeat(fa[cf[at:end]], k) + nth] * b + np.repeat(wf[at:end], k), minlength=a * b)
        at = end
    out = out.reshape(a, b)
    column = np.cumsum(many) - 1
    for k in range(0, int(many.sum()), 2048):  # elements of many: a matrix product
        ma, mb = np.zeros((a, 2048), np.float32), np.zeros((b, 2048), np.float32)
        for m, who, at_ in ((ma, wa, ca), (mb, wb, cb)):
            own = many[at_] & (column[at_] >= k) & (column[at_] < k + 2048)
            m[who[own], column[at_[own]] - k] = 1
        out += np.rint(ma @ mb.T).astype(np.int64)
    return out


class Pack(NamedTuple):
    rep: np.ndarray
    n: np.ndarray
    c: np.ndarray
    regs: np.ndarray
    d: np.ndarray
    size: np.ndarray

    def of(self, rows: np.ndarray) -> Pack:
        """Some rows, in order."""
        own = np.repeat(np.isin(np.arange(len(self.rep)), rows), self.size)
        return Pack(self.rep[rows], self.n[rows], self.c[rows], self.regs[rows], self.d[own], self.size[rows])


def forest(a: Pack, b: Pack, at: Level) -> list[tuple[int, int]]:
    """Links between members of different components that connect all that link; ``a`` and ``b`` may be one pack."""
    may = np.zeros((len(a.rep), len(b.rep)), bool)
    for j in range(len(a.rep)):
        some = np.flatnonzero((b.c != a.c[j]) & (PARTS * b.n >= at.least * a.n[j]) & (PARTS * a.n[j] >= at.least * b.n))
        some = some[(b.regs[some] == a.regs[j]).sum(1) >= at.few_equal]
        may[j, some] = may_link(np.broadcast_to(a.regs[j], (len(some), REGISTERS)), b.regs[some], np.full(len(some), a.n[j]), b.n[some], at)
    rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(rows):
        return []
    a, b = a.of(rows), b.of(cols)
    both = a.n[:, None] + b.n[None, :]
    twice = both - (a.size[:, None] + b.size[None, :] - 2 * shared_counts(a.d, a.size, b.d, b.size))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for i, j in zip(*np.nonzero(may[np.ix_(rows, cols)] & (twice * (PARTS + at.least) >= 2 * at.least * both))):
        x, y = find(int(a.c[i])), find(int(b.c[j]))
        if x != y:
            root[x] = y
            out.append((int(a.rep[i]), int(b.rep[j])))
    return out


def across(members: DataFrame, at: Level) -> DataFrame:
    """a, b: links between different components of one cluster; members: pivot, rep, n, regs, d, c, own (of the pivot's component)."""
    t = at.least / PARTS
    widest = (1 - t) / (1 + t)
    size = (F.length("d") / 8).cast("long")
    # sizes in one layer differ by a factor of t at most, and differences in one shell by what a link allows
    layer = F.floor(F.log(F.col("n").cast("double")) / -math.log(min(t, 0.99)))
    shell = F.floor(size / F.greatest(F.lit(1.0), 2 * widest * F.pow(F.lit(1 / min(t, 0.99)), F.col("layer") + 1)))
    laid = members.withColumn("size", size).withColumn("layer", layer).withColumn("shell", shell)
    cell = ["pivot", "own", "layer", "shell"]
    # behind a cut, so that both sides of the join are plain shuffles, of which Spark can split a large cell
    parts = compact(laid.groupBy(*cell).agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_ELEMENTS)).alias("parts")))[0]
    dealt = laid.join(parts, cell).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), "parts")).cast("int"))
    span = [f(k).alias(f"{f.__name__}_{k}") for k in ("n", "size", "c") for f in (F.min, F.max)]
    # dealt by chunk, else a whole cell would meet in the task that joined it with its number of parts
    packs = checkpointed(dealt.repartition(*cell, "chunk").groupBy(*cell, "chunk").agg(F.collect_list(F.struct("rep", "n", "c", "regs", "d")).alias("m"), *span).select("pivot", F.struct("own", "layer", "shell", "chunk").alias("pack"), "m", "min_n", "max_n", "min_size", "max_size", "min_c", "max_c"))
    spans = packs.drop("m")
    x, y = (spans.select("pivot", *[F.col(k).alias(f"{side}_{k}") for k in spans.columns[1:]]) for side in "xy")
    gap = F.greatest(F.col("x_min_size") - F.col("y_max_size"), F.col("y_min_size") - F.col("x_max_size"))
    meet = x.join(y, "pivot").where(
        (F.col("x_pack") <= F.col("y_pack"))
        & ((F.col("x_min_c") != F.col("y_max_c")) | (F.col("x_max_c") != F.col("y_min_c")))
        & (PARTS * F.col("x_max_n") >= at.least * F.col("y_min_n"))
        & (PARTS * F.col("y_max_n") >= at.least * F.col("x_min_n"))
        & (gap * (PARTS + at.least) <= (PARTS - at.least) * (F.col("x_max_n") + F.col("y_max_n")))
    )
    load = packs.select("pivot", "pack", "m")
    both = meet.select("pivot", "x_pack", "y_pack").join(load.toDF("pivot", "x_pack", "x"), ["pivot", "x_pack"]).join(load.toDF("pivot", "y_pack", "y"), ["pivot", "y_pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (
                    Pack(*(np.asarray(batch.column(s + f)[i].values) for f in ("rep", "n", "c")), np.frombuffer(b"".join(batch.column(s + "regs")[i].as_py()), np.uint16).reshape(-1, REGISTERS), np.frombuffer(b"".join(ds := batch.column(s + "d")[i].as_py()), U64), np.array([len(d) // 8 for d in ds]))
                    for s in "xy"
                )
                found = np.array(forest(x, y, at), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))], names=["a", "b"])
        release()

    return both.select(*[F.col(f"{s}.{f}").alias(s + f) for s in "xy" for f in ("rep", "n", "c", "regs", "d")]).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of ``edges`` (a, b)."""
    e, n = compact(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(n).distinct().coalesce(n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(n).distinct()
        e = checkpointed(small.coalesce(n))
        # a forest of stars: every node has one centre, and no centre is a leaf; then nothing changes any more
        leaves = e.groupBy("u").agg(F.count("*").alias("k")).coalesce(n)
        if leaves.where("k > 1").limit(1).count() == 0 and e.join(leaves.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(n))


def links(reps: DataFrame, docs: DataFrame, at: Level) -> DataFrame:
    """a, b: enough verified links between representatives for all components."""
    rows = band_rows(reps, at)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared, n = compact(rows.join(sizes, "bucket"))
    weights = shared.groupBy("rep").agg(F.sum("size").alias("weight")).coalesce(n)
    pivots = shared.join(weights, "rep").groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "rep"))["rep"].alias("pivot")).coalesce(n)
    pairs = compact(shared.join(pivots, "bucket").where("rep <> pivot").select("pivot", "rep").distinct())[0]
    apart = differences(pairs, reps, docs, at)
    stars = compact(apart.where("link").select(F.col("pivot").alias("a"), F.col("rep").alias("b")))[0]
    label = components(stars).toDF("rep", "c")
    labelled = apart.select("pivot", "rep").join(label, "rep", "left").join(label.toDF("pivot", "pc"), "pivot", "left")
    labelled = labelled.select("pivot", "rep", F.coalesce("c", "rep").alias("c"), F.coalesce("pc", "pivot").alias("pc"))
    several = labelled.groupBy("pivot").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("pivot")
    open_ = compact(labelled.join(several, "pivot", "left_semi"))[0]
    members = apart.drop("link").join(open_, ["pivot", "rep"]).withColumn("own", F.col("c") == F.col("pc")).drop("pc")
    return compact(stars.union(across(members, at)))[0]


def near_duplicates(docs: DataFrame, least: int = CONTRACT.least) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; ``least`` is the similarity that links, in hundredths."""
    sketched = checkpointed(sketches(docs))
    reps, _ = compact(sketched.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("regs").alias("regs")), REGISTER_ROWS)
    found = components(links(reps.where("rep is not null"), docs, level(least))).toDF("rep", "component")
    classes = reps.select("k1", "k2", "n", "rep").join(found, "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = sketched.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, least: int = CONTRACT.least) -> DataFrame:
    """The rows of ``docs`` but those whose class has a smaller id; rows without an id stay."""
    return without(docs, checkpointed(near_duplicates(docs, least).where("not kept and doc_id is not null").select("doc_id")))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), CONTRACT.least)
