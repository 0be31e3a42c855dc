"""Language identification with error-correcting output codes.

Each language has a codeword of bits: all bipartitions of the languages for up to
EXHAUSTIVE_UP_TO of them, else random balanced columns chosen for a large least distance.
One linear classifier for each bit reads hashed byte n-grams of the lower-cased text with
digits and ASCII marks taken as separators.  The classifiers are logistic regressions,
fitted together by AdaGrad on a sample of the ROWS_PER_LANGUAGE rows of each language that come
first by a hash of the id (all of them, where there are fewer).  Feature vectors, of a fixed number of
buckets, come from the executors; the driver never sees a text.

Decoding is loss-weighted: each bit adds its logistic loss against the codeword, weighted by
the bit's accuracy on the sample, and the codeword of least loss wins.  The score is the
winner's share of exp(-loss); ``ambiguous`` tells that the runner-up's loss is within
AMBIGUITY of the winner's, relative to the total weight.

Defined results: a row without an id isn't held out; null text, or text without a letter, is ``und`` with score 0 and not
ambiguous; if there is no labelled training row, every text is ``und``; whole texts are read
in blocks of bounded size; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, map_text, table

UNDETERMINED = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
N_GRAMS = (2, 3, 4)
ROWS_PER_LANGUAGE = 300
EXHAUSTIVE_UP_TO = 5
EPOCHS = 12
#: Relative features are small numbers; this brings the classifiers' outputs to the order of one early on.
SCALE = 20.0
AMBIGUITY = 0.02
BLOCK_BYTES = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
_SEPARATORS = bytes(0x20 if b < 0x80 and not (0x61 <= b <= 0x7A) else b for b in range(256))
#: Fixed odd multipliers of the n-gram hash.
_MULTIPLIERS = {n: np.uint32(m) for n, m in zip((2, 3, 4), (2654435761, 2246822519, 3266489917))}


def hashed(text: str):
    """Blocks of bucket numbers of the n-grams of a text; one block overlaps the next by the longest n-gram."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8").translate(_SEPARATORS) + b" ", np.uint8)
    for start in range(0, len(raw), BLOCK_BYTES):
        x = raw[start : start + BLOCK_BYTES + max(N_GRAMS) - 1].astype(np.uint32)
        space = x == 0x20
        code = x
        for n in range(2, max(N_GRAMS) + 1):
            code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
            if n not in N_GRAMS:
                continue
            m = min(len(code), BLOCK_BYTES)
            # separators may stand at the ends of an n-gram, not inside, and not alone
            inside = np.zeros(m, bool)
            for k in range(1, n - 1):
                inside |= space[k : k + m]
            both = space[:m] & space[n - 1 : n - 1 + m]
            yield ((code[:m] * _MULTIPLIERS[n]) >> np.uint32(32 - BUCKET_BITS))[~(inside | both)]


def counts(text: str) -> np.ndarray:
    out = np.zeros(BUCKETS, np.float32)
    for block in hashed(text):
        out += np.bincount(block, minlength=BUCKETS).astype(np.float32)
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= EXHAUSTIVE_UP_TO:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float32).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, best_distance = None, -1
    for _ in range(200):
        m = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0).astype(np.float32)
        distance = min((m[i] != m[j]).sum() for i in range(n) for j in range(i))
        if distance > best_distance and (np.abs(m.sum(0)) < n).all():
            best, best_distance = m, distance
    return best


def sample(labelled: DataFrame, rows_per_language: int) -> DataFrame:
    """The first ``rows_per_language`` rows of each language by a hash of the id: doc_id, lang and the sparse relative features."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    # a language that has more has twice as many below this, but for a chance of exp(-100)
    share = {r["lang"]: 2 * rows_per_language / r["n"] if r["n"] > 2 * rows_per_language else 2.0 for r in sizes.collect()}  # one row a language
    if not share:
        return labelled.select("doc_id", "lang", F.array().cast("array<int>").alias("at"), F.array().cast("array<float>").alias("x"))
    wanted = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])
    first = Window.partitionBy("lang").orderBy("chance", "doc_id", "text")
    some = labelled.withColumn("chance", chance).where(F.col("chance") < wanted[F.col("lang")])
    chosen = some.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rows_per_language).select("doc_id", "lang", "text")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, x = [], []
        for text in batch.column("text").to_pylist():
            c = counts(text)
            found = np.flatnonzero(c)
            at.append(found.astype(np.int32))
            x.append((c[found] / max(1.0, c.sum()) * SCALE).astype(np.float32))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "lang", "at", "x"])

    return map_text(chosen, features, "doc_id long, lang string, at array<int>, x array<float>")


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """languages, codewords, weights (buckets x bits), bias and bit weights."""
    got = sample(labelled, rows_per_language).select("lang", "at", "x", "doc_id").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["at"], r["x"]))  # the order in which partitions arrive must not matter
    languages = sorted({r["lang"] for r in got})
    code = codewords(len(languages))
    bits = code.shape[1] if languages else 1
    w, b, g2, gb2 = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32), np.full((BUCKETS, bits), 1e-6, np.float32), np.full(bits, 1e-6, np.float32)
    rows = [(np.array(r["at"], np.int64), np.array(r["x"], np.float32), code[languages.index(r["lang"])]) for r in got if r["at"]]
    per_language = {k: sum(1 for r in got if r["lang"] == k) for k in languages}
    weight = [len(got) / len(languages) / per_language[r["lang"]] for r in got if r["at"]]
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS if len(languages) > 1 else 0):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            z = x @ w[at] + b
            d = -y / (1 + np.exp(np.clip(y * z, -30, 30))) * weight[i]
            g = np.outer(x, d) + 1e-6 * w[at]
            g2[at] += g * g
            gb2 += d * d
            w[at] -= 0.2 * g / np.sqrt(g2[at])
            b -= 0.02 * d / np.sqrt(gb2)
    right = np.ones(bits)
    if rows and len(languages) > 1:
        right = np.mean([(y * (x @ w[at] + b) > 0) for at, x, y in rows], axis=0)
    return {"languages": languages, "code": code, "w": w, "b": b, "bit_weight": (right / right.sum()).astype(np.float32)}


def decode(model: dict, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, score and ambiguity for rows of classifier outputs."""
    n = len(model["languages"])
    if n == 1:
        return np.zeros(len(z), int), np.ones(len(z)), np.zeros(len(z), bool)
    loss = np.stack([(np.logaddexp(0, -z * model["code"][k]) * model["bit_weight"]).sum(1) for k in range(n)], axis=1)
    order = np.argsort(loss, axis=1, kind="stable")
    share = np.exp(-(loss - loss.min(1, keepdims=True)) * z.shape[1])
    rows = np.arange(len(z))
    return order[:, 0], share[rows, order[:, 0]] / share.sum(1), loss[rows, order[:, 1]] - loss[rows, order[:, 0]] < AMBIGUITY


def identify(docs: DataFrame, model: dict, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Every row of ``docs`` with three more columns; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats
    others = [f for f in docs.schema.fields if f.name not in names]
    kept = [f.name for f in others]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts = batch.column("text").to_pylist()
        z, known = np.zeros((len(texts), m["w"].shape[1]), np.float32), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            if not text or not LETTER.search(text) or not m["languages"]:
                continue
            known[i], n = True, 0
            total = np.zeros(m["w"].shape[1], np.float64)
            for block in hashed(text):
                # long blocks meet most buckets several times: count first, then one product
                total += np.bincount(block, minlength=BUCKETS) @ m["w"] if len(block) > BUCKETS else m["w"][block].sum(0, dtype=np.float64)
                n += len(block)
            z[i] = total * SCALE / max(1, n) + m["b"]
        best, score, ambiguous = decode(m, z) if m["languages"] else (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool))
        languages = [m["languages"][k] if ok else UNDETERMINED for k, ok in zip(best, known)]
        new = [pa.array(languages, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(ambiguous & known, pa.bool_())]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, names=[*kept, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean"))])
    return map_text(docs.select(*[f"`{c}`" for c in kept]), run, schema)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told without doubt, by a model fitted on their own labels."""
    names = ("__lang_pred", "__lang_score", "__lang_ambiguous")
    judged = identify(docs, fit(training_rows(docs)), names)
    return judged.where((F.col(names[0]) != UNDETERMINED) & ~F.col(names[2])).select(*[f"`{c}`" for c in docs.columns])


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: outside the held-out third, with text and language."""
    return docs.where(F.coalesce(~held_out(), F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return identify(rows, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
