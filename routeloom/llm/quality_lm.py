"""Quality rules: base rules and a perplexity band by a character 5-gram model.

Counting.  Texts are lower-cased, digits read as 0, and runs of white space as one space; a run
of one mark reads as that mark, else its sure repetition would make marked-up junk look likely;
code points from 4096 on are folded into 2048 classes, so that a 5-gram packs into one long
and its prefixes and suffixes are shifts and masks.  Python tasks count packed 5-grams by
sorting blocks and combine what a task has seen; Spark adds the counts up.  All documents
count, whole.

Model.  Interpolated modified Kneser-Ney for each language: raw counts at the highest order,
continuation counts below, three discounts from the counts of counts.  Probabilities and
backoff weights are computed as DataFrames.  Every 5-gram of a counted text is in the model,
so its interpolated probability is all that scoring needs.  The most frequent 5-grams of all
languages together, up to RESIDENT, go to the executors as arrays sorted by a 64-bit hash of
(language, order, gram), which is a bijection within a language: a look-up compares the whole
key, and nothing is averaged.  5-grams beyond that stay a table: documents hand on which of
them they hold, how often, and a join adds their share.  They are the rare ones, so no key of
that join is hot, and results are the same wherever the border lies.  Rows without a language
have a model of their own.

Verdict.  Perplexity of a text under its language's model; a language's band runs from its
median log-perplexity BAND times the distance to the lower and upper quartile (at least
MIN_SPREAD) down and up, taken over all texts that pass the base rules; quartiles stand up to
a quarter of junk.  A mean over few characters varies more, so SHORT_TEXT / sqrt(characters)
is added on both sides.  Texts outside the band are rejected.

Defined results: null text has no words, fails the base rules and has a null perplexity;
whole texts are used; ties and repeated rows get equal verdicts; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, slices, table

ORDER = 5
CHAR_BITS = 12
#: 5-grams kept in memory by each Python worker, with some 20 bytes for each.
RESIDENT = 1 << 22
#: Rows of a table of figures by language that may be broadcast, of some 100 bytes; larger ones are joined.
BROADCAST_ROWS = 100_000
OTHER = "\u0000other"
PAD = 1
BAND, MIN_SPREAD, SHORT_TEXT = 5.0, 0.015, 2.5
#: Bytes of text worked on at a time; some twelve arrays of eight bytes for each stand beside it.
BLOCK_BYTES = 1 << 20
#: Packed 5-grams that a task holds before it hands its counts on.
HELD_GRAMS = 1 << 20
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE_RUNS = re.compile(r"\s{2,}|[^\S ]")
MARK_RUNS = re.compile(r"([^\w\s])\1+")
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]").search
SYMBOLS = "#*$%&|<>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str) -> np.ndarray:
    """Code points of the normalised text, below 4096."""
    plain = MARK_RUNS.sub(r"\1", SPACE_RUNS.sub(" ", text.lower()))
    c = np.frombuffer(plain.encode("utf-32-le", "replace"), np.uint32)
    c = np.where((c > 48) & (c < 58), np.uint32(48), c)
    return np.where(c < 4096, c, 2048 + (c & 2047)).astype(np.uint64) if len(c) and c.max() >= 4096 else c.astype(np.uint64)


def packed(text: str) -> np.ndarray:
    """The packed 5-gram that ends at each character, with PAD before the text."""
    c = np.concatenate([np.full(ORDER - 1, PAD, np.uint64), folded(text)])
    n = len(c) - ORDER + 1
    g = np.zeros(n, np.uint64)
    for k in range(ORDER):
        g = (g << np.uint64(CHAR_BITS)) | c[k : k + n]
    return g


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def count_grams(texts: DataFrame) -> DataFrame:
    """lang, gram, c over whole texts of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        sizes: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            sizes.pop(lang)
            keys, n = add_up(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "c"])

        for batch in batches:
            for piece in slices(batch, limit=BLOCK_BYTES):
                by_lang: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                    if text:
                        by_lang.setdefault(lang, []).append(packed(text))
                for lang, grams in by_lang.items():
                    g = np.sort(np.concatenate(grams))
                    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                    parts = held.setdefault(lang, [])
                    parts.append((g[starts], np.diff(np.append(starts, len(g)))))
                    sizes[lang] = sizes.get(lang, 0) + len(starts)
                if sum(sizes.values()) > HELD_GRAMS:
                    for lang, parts in held.items():
                        parts[:] = [add_up(parts)]
                        sizes[lang] = len(parts[0][0])
                    if sum(sizes.values()) > HELD_GRAMS // 2:
                        for lang in list(held):
                            yield out(lang)
        for lang in list(held):
            yield out(lang)

    return texts.mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _low(gram: Column, chars: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (CHAR_BITS * chars)) - 1))


def beside(df: DataFrame) -> DataFrame:
    """A small table behind a cut, broadcast if its number of rows has been found small."""
    cut = checkpointed(df)
    return F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, k (order), gram, logp, bow, n: the interpolated model as rows; bow is the log weight left for the next lower order in the context ``gram``."""
    levels = {ORDER: counts.select("lang", "gram", "c")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("lang", _low(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("c"))
    levels = {k: checkpointed(df) for k, df in levels.items()}
    tallies = None
    for k, df in levels.items():
        one = df.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)], F.sum("c").alias("total"), F.count("*").alias("kinds")).withColumn("k", F.lit(k))
        tallies = one if tallies is None else tallies.unionByName(one)
    safe = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(i: int) -> Column:
        raw = i - (i + 1) * safe * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.when((raw > 0) & (raw < i), raw).otherwise(F.lit(0.5 * i)).alias(f"d{i}")

    rates = checkpointed(tallies.select("lang", "k", "kinds", d(1), d(2), d(3)))  # five rows a language
    few = rates.count() <= BROADCAST_ROWS
    out, lower = None, None
    for k in range(1, ORDER + 1):
        r = rates.where(F.col("k") == k).drop("k")
        r = F.broadcast(r) if few else r
        a = levels[k].join(r, "lang").withColumn("ctx", F.shiftright("gram", CHAR_BITS))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        a = a.withColumn("cut", cut)
        ctx = a.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("left"))
        p = a.join(ctx, ["lang", "ctx"]).withColumn("own", (F.col("c") - F.col("cut")) / F.col("total")).withColumn("share", F.col("left") / F.col("total"))
        if k == 1:
            # below the unigrams: uniform over the characters seen and one for all others
            p = p.withColumn("p", F.col("own") + F.col("share") / (F.col("kinds") + 1))
        else:
            p = p.withColumn("low", _low(F.col("gram"), k - 1)).join(lower, ["lang", "low"]).withColumn("p", F.col("own") + F.col("share") * F.col("p_low"))
        p = checkpointed(p.select("lang", "gram", "ctx", "c", "p", "share", "kinds"))
        lower = p.select("lang", F.col("gram").alias("low"), F.col("p").alias("p_low"))
        rows = p.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("bow"), F.col("c").alias("n"))
        weights = p.groupBy("lang", "ctx").agg(F.log(F.first("share")).alias("bow"), F.sum("c").alias("n"), F.first("kinds").alias("kinds"))
        # order 0: what a character that the language never had gets
        unseen = -F.log(F.col("kinds") + 1.0) if k == 1 else F.lit(None).cast("double")
        weights = weights.select("lang", F.lit(k - 1).alias("k"), F.col("ctx").alias("gram"), unseen.alias("logp"), "bow", "n")
        both = rows.unionByName(weights)
        out = both if out is None else out.unionByName(both)
    return out


def keys_of(lang: str, k: int, gram: np.ndarray) -> np.ndarray:
    """64-bit hashes of grams of order ``k``; different grams and orders of a language have different ones."""
    of_lang = int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "big")
    return (gram ^ np.uint64(k << 60) ^ np.uint64(of_lang)) * _ODD


class Model:
    """Arrays sorted by hash, and the first entry of each range of hashes."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, bow: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logp, self.bow = np.append(keys[order], np.uint64(0xFFFFFFFFFFFFFFFF)), logp[order].astype(np.float32), bow[order].astype(np.float32)
        bits = min(24, max(8, (2 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        at = self.first[(keys >> self.shift).astype(np.int32)]
        there = self.keys[at]
        out = np.where(there == keys, at, -1)
        out[at == len(self.logp)] = -1
        open_ = np.flatnonzero(there < keys)
        at = at[open_]
        while len(open_):  # hashes are spread evenly, so a range holds few
            at = at + 1
            there, want = self.keys[at], keys[open_]
            hit = (there == want) & (at < len(self.logp))
            out[open_[hit]] = at[hit]
            more = (there < want) & (at < len(self.logp))
            open_, at = open_[more], at[more]
        return out


def collect_model(rows: DataFrame) -> Model:
    """The model of ``rows`` (lang, k, gram, logp, bow), which the caller has bounded."""

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, k, g = np.asarray(b.column("lang").to_pylist(), object), np.asarray(b.column("k")), np.asarray(b.column("gram")).view(np.uint64)
            keys = np.zeros(len(g), np.uint64)
            for name in set(lang.tolist()):
                for order in range(ORDER + 1):
                    own = (lang == name) & (k == order)
                    keys[own] = keys_of(name, order, g[own])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column("logp").cast(pa.float32()), b.column("bow").cast(pa.float32())], names=["key", "logp", "bow"])

    t = rows.select("lang", "k", "gram", "logp", "bow").mapInArrow(to_keys, "key long, logp float, bow float").toArrow()
    return Model(np.asarray(t.column("key")).view(np.uint64), t.column("logp").to_numpy(), np.nan_to_num(t.column("bow").to_numpy(), nan=0.0))


def log_probability(model: Model, lang: str, grams: np.ndarray) -> np.ndarray:
    """Log probability of each packed 5-gram's last character, for texts that the model hasn't counted too: unseen ones back off."""
    out, weight, open_ = np.zeros(len(grams)), np.zeros(len(grams)), np.arange(len(grams))
    for k in range(ORDER, -1, -1):
        g = grams[open_] & np.uint64((1 << (CHAR_BITS * k)) - 1)
        at = model.find(keys_of(lang, k, g))
        found = np.where(at >= 0, model.logp[at], np.nan)
        seen = ~np.isnan(found)
        out[open_[seen]] = weight[open_[seen]] + found[seen]
        open_, g = open_[~seen], g[~seen]
        if not len(open_):
            return out
        if k:
            at = model.find(keys_of(lang, k - 1, g >> np.uint64(CHAR_BITS)))
            weight[open_] += np.where(at >= 0, model.bow[at], 0.0)
    out[open_] = np.nan  # no model of this language
    return out


def base_figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORDS.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if HAS_WORD(x)]
    repeat = 0
    if n > 8:
        ids: dict[str, int] = {}
        x = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
        if len(ids) < n:
            # a window is found by the 64-bit hash of its word numbers
            x = (x + np.uint64(1)) * _ODD
            x ^= x >> np.uint64(29)
            m = n - 7
            h = np.zeros(m, np.uint64)
            for k in range(8):
                h = (h * np.uint64(0xD6E8FEB86659FD93)) + x[k : k + m]
                h ^= h >> np.uint64(32)
            order = np.argsort(h, kind="stable")
            s = h[order]
            same = np.concatenate([[False], s[1:] == s[:-1]])
            same[:-1] |= same[1:]
            if same.any():
                mark = np.zeros(n + 1, np.int32)
                at = order[same]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + 8, -1)
                repeat = int((np.cumsum(mark)[:n] > 0).sum())
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def resident_part(rows: DataFrame, resident: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent 5-grams, about ``resident`` at most, and the others, if there are."""
    top = rows.where(F.col("k") == ORDER)
    total = top.count()
    if total <= resident:
        return top, None
    least = top.agg(F.percentile_approx("n", max(0.0, 1 - 0.9 * resident / total), 10_000)).first()[0]
    return top.where(F.col("n") > least), top.where(F.col("n") <= least)


def score(docs: DataFrame, rows: DataFrame, resident: int = RESIDENT) -> DataFrame:
    """doc_id, model_lang, base figures and log-perplexity of the rows (doc_id, lang, text) that the model ``rows`` has counted."""
    held, others = resident_part(rows, resident)
    partial = others is not None
    shared = docs.sparkSession.sparkContext.broadcast(collect_model(held))  # RESIDENT entries
    names = ["doc_id", "model_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "log_sum", "missed"]
    missed_type = pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for piece in slices(batch, limit=BLOCK_BYTES):
                langs, texts = piece.column("lang").to_pylist(), piece.column("text").to_pylist()
                base = np.array([base_figures(t or "") for t in texts], np.int64).reshape(-1, 5)
                chars, total, missed = np.zeros(len(texts), np.int64), np.zeros(len(texts)), [[] for _ in texts]
                for lang in set(langs):
                    own = [i for i, t in enumerate(texts) if t and langs[i] == lang]
                    if not own:
                        continue
                    grams = [packed(texts[i]) for i in own]
                    sizes = [len(g) for g in grams]
                    starts = np.cumsum([0, *sizes[:-1]])
                    g = np.concatenate(grams)
                    at = m.find(keys_of(lang, ORDER, g))
                    chars[own] = sizes
                    total[own] = np.add.reduceat(np.where(at >= 0, np.append(m.logp, np.float32(0))[at].astype(np.float64), 0.0), starts)
                    if partial:
                        gone = np.flatnonzero(at < 0)
                        cuts = np.searchsorted(gone, [*starts, len(g)])
                        for j in np.flatnonzero(np.diff(cuts)):
                            kinds, times = np.unique(g[gone[cuts[j] : cuts[j + 1]]], return_counts=True)
                            missed[own[j]] = [{"gram": int(k), "times": int(n)} for k, n in zip(kinds, times)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("lang"), *[pa.array(base[:, j]) for j in range(5)], pa.array(chars), pa.array(total), pa.array(missed, missed_type)], names=names)

    done = checkpointed(docs.mapInArrow(run, "doc_id long, model_lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars long, log_sum double, missed array<struct<gram:long,times:long>>"))
    if partial:
        done = done.withColumn("row", F.monotonically_increasing_id())  # of a table behind a cut, so the same each time
        each = done.select("row", F.col("model_lang").alias("lang"), F.explode("missed").alias("m")).select("row", "lang", "m.gram", "m.times")
        more = each.join(others.select("lang", "gram", "logp"), ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("more"))
        done = checkpointed(done.join(more, "row", "left").withColumn("log_sum", F.col("log_sum") + F.coalesce("more", F.lit(0.0))))
    return done.select(*names[:7], (-F.col("log_sum") / F.when(F.col("chars") > 0, F.col("chars"))).alias("log_ppl"))


def judge(scored: DataFrame) -> DataFrame:
    """Base verdict, bands by language and ``kept``."""
    base = scored.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    q = F.percentile_approx(F.when(~F.col("base_failed"), F.col("log_ppl")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10000)).alias("q")
    bands = base.groupBy("model_lang").agg(q).select(
        "model_lang",
        (F.col("q")[1] - BAND * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(MIN_SPREAD))).alias("low"),
        (F.col("q")[1] + BAND * F.greatest(F.col("q")[2] - F.col("q")[1], F.lit(MIN_SPREAD))).alias("high"),
    )
    slack = SHORT_TEXT / F.sqrt(F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1)))
    joined = base.join(beside(bands), "model_lang").withColumn("band_low", F.col("low") - slack).withColumn("band_high", F.col("high") + slack).drop("low", "high")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("band_low"), F.col("band_high")), F.lit(False)))


def quality(docs: DataFrame, resident: int = RESIDENT) -> DataFrame:
    """doc_id, model_lang, base figures, log_ppl, the band and ``kept`` of every row of (doc_id, lang, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit(OTHER)).alias("lang"), "text")
    counts = checkpointed(count_grams(rows.select("lang", "text")))
    return judge(score(rows, kneser_ney(counts), resident))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_ppl").alias("perplexity"), "log_ppl", "band_low", "band_high")
