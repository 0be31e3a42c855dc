"""Empty tables, nulls in any column, clashing names and very long texts, for every operator and the pipeline."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routeloom.llm import chat, decontaminate, html_template, language_id, near_dup, pii, quality_lm, sentencepiece_fst, token_counts, warc_audit

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    """Nulls in every column, repeated rows and ids, and columns named like those that operators make."""
    text = "the cat of the house and a dog in the garden with an old tree " * 3
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text, "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0), (4, " \n", "en", "s", 2), (5, "\x00 é 日本", "fr", "s", 5)]
    d = spark.createDataFrame(rows, DOCS)
    for name in ("bench_matches", "pii_counts", "score", "lang_pred", "n", "regs", "rep", "c", "gram", "chars", "ids", "missed", "row", "k1"):
        d = d.withColumn(name, F.lit(f"clash {name}"))
    return d


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight"), (None, "x"), (2, None)], "item_id long, text string")


OPERATORS = {
    "language_id": lambda s, d: language_id.identify(d, language_id.fit(language_id.training_rows(d))),
    "keep_known": lambda s, d: language_id.keep_known(d),
    "token_counts": lambda s, d: token_counts.token_counts(d, BYTES),
    "encode": lambda s, d: sentencepiece_fst.encode(d, PIECES),
    "decontaminate": lambda s, d: decontaminate.with_matches(d, bench(s)),
    "near_duplicates": lambda s, d: near_dup.near_duplicates(d),
    "deduplicate": lambda s, d: near_dup.deduplicate(d),
    "pii": lambda s, d: pii.pseudonymise(d, b"key"),
    "quality": lambda s, d: quality_lm.quality(d),
    "quality in a table": lambda s, d: quality_lm.quality(d, resident=1),
}
FILTERS = {"keep_known", "deduplicate"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    d = documents(spark)
    out = OPERATORS[name](spark, d).collect()
    assert len(out) <= 8 if name in FILTERS else len(out) == 8
    assert OPERATORS[name](spark, d.where("n_chars > 99")).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents(spark), documents(spark).where("n_chars > 99")):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert all(r[f"{c}"] == f"clash {c}" for r in out.select("bench_matches", "pii_counts", "score").collect() for c in ("bench_matches", "pii_counts", "score"))
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_pieces", "n_fallback", "ids", "round_trip"]


def test_empty_pages_records_and_conversations(spark):
    p = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_template.extract(p).count() == 0 and warc_audit.audit(p, p).count() == 0
    c = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(c)).count() == 0


def test_very_long_texts(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choice("aeiourstln") for _ in range(r.randrange(2, 8))) for _ in range(3000)]
    long = " ".join(r.choice(vocabulary) for _ in range(250_000))
    near = long.replace(" ", "\n", 7) + " more words at the end"
    d = spark.createDataFrame([(1, long, "en"), (2, near, "en"), (3, "w" * 1_000_000, "en"), (4, "a b " * 300_000, None)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in near_dup.near_duplicates(d).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[3]["n_shingles"] == 1 and got[4]["n_shingles"] == 2
    kept = {x["doc_id"]: x for x in quality_lm.quality(d).collect()}
    assert [kept[i]["base_failed"] for i in (3, 4)] == [True, True] and kept[1]["n_words"] == 250_000
    assert {x["doc_id"]: x["round_trip"] for x in sentencepiece_fst.encode(d, PIECES).collect()} == {1: True, 2: True, 3: True, 4: True}
    assert token_counts.token_counts(d, BYTES).where("n_tokens > 0").count() == 4
    page = "<article>" + "<p>one &amp; two</p>" * 50_000 + "</article>" + "<div>" * 3000
    out = html_template.extract(spark.createDataFrame([(1, "http://a/", page)], "page_id long, url string, html string")).first()
    assert out["n_chars"] == 50_000 * len("one & two\n") - 1
    chats = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", near)], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(chats)).first()["loss_chars"] == len(near)


def test_decoding_equals_brute_force():
    """Loss-weighted decoding written out language by language."""
    r = np.random.default_rng(3)
    for n in (2, 3, 5, 9):
        code = language_id.codewords(n)
        w = r.random(code.shape[1]).astype(np.float32)
        model = {"languages": [str(i) for i in range(n)], "code": code, "bit_weight": w / w.sum()}
        z = r.normal(0, 3, (40, code.shape[1])).astype(np.float32)
        best, score, ambiguous = language_id.decode(model, z)
        for i in range(40):
            losses = [sum(float(model["bit_weight"][b]) * np.log1p(np.exp(-float(z[i, b]) * code[k, b])) for b in range(code.shape[1])) for k in range(n)]
            order = sorted(range(n), key=losses.__getitem__)
            shares = [np.exp(-(x - losses[order[0]]) * code.shape[1]) for x in losses]
            assert best[i] == order[0] and score[i] == pytest.approx(1 / sum(shares), rel=1e-3)
            assert bool(ambiguous[i]) == (losses[order[1]] - losses[order[0]] < language_id.AMBIGUITY)
