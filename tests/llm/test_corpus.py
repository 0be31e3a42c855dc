"""Near duplicates, decontamination, HTML, perplexity, Merkle audit and the pipeline: against brute force on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import decontaminate, html_template, near_dup, quality_lm, warc_audit


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(texts):
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_texts():
    r, texts = random.Random(3), {}
    for _ in range(12):
        base = words(r, r.choice([4, 9, 30, 120, 200]))
        for _ in range(r.choice([1, 2, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
            texts[len(texts)] = " ".join(w) if r.random() < 0.8 else "\n".join(w).upper()
    return texts | {500: None, 501: "", 502: " \n", 503: "one", 504: "ONE", 505: "a b c d", 506: "A b c d"}


@pytest.mark.parametrize("salt, chunk, elements", [(2048, 512, 1 << 18), (2, 4, 1 << 18), (3, 100, 64)])
def test_near_duplicates(spark, monkeypatch, salt, chunk, elements):
    monkeypatch.setattr(near_dup, "SALT", salt)
    monkeypatch.setattr(near_dup, "CHUNK", chunk)
    monkeypatch.setattr(near_dup, "CHUNK_ELEMENTS", elements)
    texts = near_texts()
    d = spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = near_dup.near_duplicates(d).collect()
    component, sizes = brute_components(texts)
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: r["component_id"] for r in got} == component
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near_dup.deduplicate(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == set(component.values())


def test_group_of_near_copies_around_one_text(spark, monkeypatch):
    """Many texts within reach of one centre, of each other, or of neither: chains that pivots alone don't see."""
    monkeypatch.setattr(near_dup, "CHUNK", 16)
    r, texts = random.Random(8), {}
    base = words(r, 120, 9000)
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"x{r.randrange(12)}"
        texts[i] = " ".join(w)
        if r.random() < 0.3:
            w[r.randrange(len(w))] = f"y{i}"
            texts[1000 - i] = " ".join(w)
    got = near_dup.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    component, _ = brute_components(texts)
    assert {x["doc_id"]: x["component_id"] for x in got} == component and 20 < len(set(component.values())) < 200


def test_shared_counts_equal_brute_force():
    r = np.random.default_rng(5)
    for top in (10, 60, 100_000):
        a, b = ([np.unique(r.integers(0, top, r.integers(0, 50))).astype(np.uint64) for _ in range(k)] for k in (23, 31))
        got = near_dup.shared_counts(np.concatenate(a), np.array([len(x) for x in a]), np.concatenate(b), np.array([len(x) for x in b]))
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 63, 2000).astype(np.uint64), r.integers(0, 1 << 63, 500).astype(np.uint64)
    assert np.array_equal(near_dup.merge(near_dup.registers(a), near_dup.registers(b)), near_dup.registers(np.concatenate([a, b])))
    errors = []
    for share in (0.2, 0.5, 0.85):
        for _ in range(20):
            x = r.integers(0, 1 << 63, 1000).astype(np.uint64)
            k = int(1000 * 2 * share / (1 + share))
            y = np.concatenate([x[:k], r.integers(0, 1 << 63, 1000 - k).astype(np.uint64)])
            j = near_dup.estimate(near_dup.registers(x)[None], near_dup.registers(y)[None], np.array([1000.0]), np.array([1000.0]))[0]
            errors.append(j - k / (2000 - k))
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.2


def test_words_are_hashed_alike_in_blocks(monkeypatch):
    t = " ".join(words(random.Random(1), 3000))
    whole = near_dup.shingle_sets([t, None, "x " + t])
    monkeypatch.setattr(near_dup, "BLOCK", 1000)
    near_dup._block_powers.cache_clear()
    assert all(np.array_equal(a, b) for a, b in zip(whole, near_dup.shingle_sets([t, None, "x " + t])))
    near_dup._block_powers.cache_clear()
    assert len(near_dup.shingle_sets(["y" * 5000 + " z"])[0]) == 1


def brute_tiles(doc, item):
    free_d, free_t, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                k = 0
                while p + k < len(doc) and q + k < len(item) and free_d[p + k] and free_t[q + k] and doc[p + k] == item[q + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, q)
        k, p, q = best
        if k < decontaminate.MIN_MATCH:
            return out
        out.append(best)
        for i in range(k):
            free_d[p + i] = free_t[q + i] = False


def test_tiling_equals_brute_force():
    r = random.Random(3)
    for _ in range(200):
        item, doc = [r.choice("abcdefgh") for _ in range(r.randint(5, 30))], []
        for _ in range(r.randint(0, 5)):
            a = r.randint(0, len(item) - 1)
            doc += item[a : a + r.randint(1, 14)] + [r.choice("abcxyz") for _ in range(r.randint(0, 3))]
        got = decontaminate.match([" ".join(doc)], decontaminate.Benchmark([(1, " ".join(item))]), 0.0)[0]
        assert (got[0]["coverage"] if got else 0) == pytest.approx(sum(k for k, _, _ in brute_tiles(doc, item)) / len(item))


def test_decontamination_finds_reordered_passages(spark):
    r = random.Random(9)
    item = words(r, 40, 10_000)
    reordered = item[25:] + ["and"] + item[:25]
    rows = [(1, " ".join(words(r, 300) + item + words(r, 20))), (2, " ".join(words(r, 50) + reordered).upper() + "!"), (3, " ".join(words(r, 500))), (4, None), (5, ""), (6, " ".join(item[:15])), (1, "clean row of the same id")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (7, " ".join(item))], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bench_matches", F.lit("clash"))
    got = [(x["doc_id"], [(m["item_id"], m["tiles"], m["coverage"]) for m in x["bench_matches"]]) for x in decontaminate.with_matches(d, bench).collect()]
    hit = {k for k, m in got if m}
    assert hit == {1, 2} and dict(got)[2] == [(7, 2, 1.0), (7, 2, 1.0)]
    assert decontaminate.with_matches(d, bench.where("item_id < 0")).where(F.size("bench_matches") > 0).count() == 0
    assert decontaminate.with_matches(d.where("doc_id < 0"), bench).count() == 0
    assert sum(len(b) for _, b in decontaminate.blocks(bench, 5)) == 3
    in_blocks = decontaminate.with_matches(d, bench, block_tokens=5).collect()
    assert {x["doc_id"] for x in in_blocks if x["bench_matches"]} == {1, 2}


PAGE = '<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>x="</p>"</script></head><body><nav><ul><li><a href=/a>{n}</a></li></ul></nav><div class="{ad}">{t} ad</div>{open}<h1>{t}</h1><p>{a} &amp; b<p>second\n  part {a}{close}<div class=comments><p>me too</p></div><footer>&copy; all</footer>{end}'


def test_pages(spark):
    rows = []
    for i in range(12):
        main = i % 2
        rows.append((i, f"http://h{i % 2}.org/x{i}", PAGE.format(t=f"title {i}", n=f"nav {i}", ad="ad" if main else "ads box", a=f"text {i}", open="<article>" if main else "<div id=content>", close="</article>" if main else "</div>", end="</body></html>" if i % 3 else "")))
    rows += [(100, None, None), (101, "http://one.org/", ""), (102, "no url", "<p>only <b>this</b> &eacute;<br>line two<script>no</script>"), (0, rows[0][1], rows[0][2])]
    got = {r["page_id"]: r for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    for i in range(12):
        assert got[i]["text"] == f"title {i}\ntext {i} & b\nsecond part text {i}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (100, 101, 102)] == ["", "", "only this é\nline two"]
    assert html_template.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_text_outside_articles_goes(spark):
    rows = [(i, "http://a.org/", f"<body><div id=b><p>All rights kept</p></div><div id=c><p>story {i}</p><p>more of {i}</p></div></body>") for i in range(8)]
    got = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"story {r['page_id']}\nmore of {r['page_id']}" for r in got)


def notice_pages():
    """Articles with a notice that no name gives away, copies of one article, and a teaser beside the text proper."""
    notice = "<p>Read on with a free trial of our paper</p>"
    rows = [(i, "http://a.org/", f"<body><div id=top><em>The Paper</em></div><article><h1>head {i}</h1>{notice}<p>story {i} goes on</p></article></body>") for i in range(10)]
    rows += [(20 + i, "http://b.org/", f"<body><script>{i}</script><article><p>One text</p><p>on all pages</p></article></body>") for i in range(9)]
    rows += [(40 + i, "http://c.org/", f"<body><article><p>next: {i}</p></article><div id=x><p>{'long text proper %d ' % i * 20}</p></div></body>") for i in range(3)]
    return rows


def test_template_decides_inside_articles(spark, monkeypatch):
    d = spark.createDataFrame(notice_pages(), "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.extract(d).collect()}
    assert all(got[i] == f"head {i}\nstory {i} goes on" for i in range(10))
    assert all(got[20 + i] == "One text\non all pages" for i in range(9))
    assert all(got[40 + i].endswith("long text proper %d " % i * 1 + "long text proper %d" % i) for i in range(3))
    monkeypatch.setattr(html_template, "templates", lambda counts, sizes: sizes.select("host", F.array().cast("array<long>").alias("template")).where("false"))
    without = {r["page_id"]: r["text"] for r in html_template.extract(d).collect()}
    assert all("free trial" in without[i] for i in range(10)) and without != got


def brute_template(pages):
    """The template of one host by explicit occurrence vectors: {token} of valid classes nested from the root."""
    parser, on_page, parent, in_main = html_template.Parser(), [], {}, set()
    for source in pages:
        n = Counter()
        for kind, e, raw in parser.walk(source):
            text = html_template.tidy(raw).strip()
            if kind == "open" or (kind == "text" and text):
                token = e.path if kind == "open" else html_template.hash64(e.path, text)
                parent[token] = e.parent.path if kind == "open" else e.path
                in_main |= {token} if kind == "text" and e.main else set()
                n[token] += 1
        on_page.append(n)
    vector = {t: tuple(n[t] for n in on_page) for t in parent}
    support = {t: sum(x > 0 for x in v) for t, v in vector.items()}
    frequent = {t for t in parent if support[t] >= max(*((html_template.MAIN_PAGES, html_template.MAIN_SHARE * len(pages)) if t in in_main else (html_template.MIN_PAGES, html_template.MIN_SHARE * len(pages))))}
    root = parser.root.path

    def holds(t):
        return all(parent[x] == root or (parent[x] in frequent and support[parent[x]] >= support[x]) for x in frequent if vector[x] == vector[t])

    valid = {t for t in frequent if holds(t)}
    while (orphans := {t for t in valid if parent[t] != root and parent[t] not in valid}):
        valid -= orphans
    return valid


def test_templates_equal_brute_force(spark):
    r, rows = random.Random(4), []
    for host in range(6):
        for i in range(r.choice([2, 5, 12, 30])):
            bits = ["<nav><a href=/>home</a></nav>", "<div class=x><p>same words</p></div>", f"<div id=y><b>{r.choice('pq')}</b></div>", f"<article><p>t{host}-{i}</p><p>inside</p></article>", "<ul><li>1<li>2</ul>", "<footer>end</footer>"]
            rows.append((len(rows), f"http://h{host}/", "<html><body>" + "".join(b for b in bits if r.random() < 0.85) + "</body></html>"))
    d = spark.createDataFrame([(p, u[7:-1], h) for p, u, h in rows], "page long, host string, html string")
    counts = html_template.token_counts(d.repartition(5))
    got = {x["host"]: set(x["template"]) for x in html_template.templates(counts, d.groupBy("host").agg(F.count("*").alias("pages"))).collect()}
    for host in {u[7:-1] for _, u, _ in rows}:
        want = brute_template([h for _, u, h in rows if u[7:-1] == host])
        assert got.get(host, set()) == want and (want or sum(u[7:-1] == host for _, u, _ in rows) < 3)


def test_base_figures_equal_brute_force():
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(["a ", "b ", "c ", "a b c a b c a b ", "\n", "\t", "#*", "d\n", " e "]) for _ in range(r.randrange(60)))
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        marked = {i + k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked))
        assert quality_lm.base_figures(text) == want


def brute_kneser_ney(texts):
    """Probabilities of order 5 by the textbook, over packed characters."""
    grams = Counter(g for t in texts for g in quality_lm.packed(t).tolist())
    levels, bits = {5: dict(grams)}, quality_lm.CHAR_BITS
    for k in range(4, 0, -1):
        levels[k] = dict(Counter(g & ((1 << bits * k) - 1) for g in levels[k + 1]))
    probability = {}
    for k in range(1, 6):
        c, kinds = levels[k], len(levels[k])
        n = [0, *[sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]]
        d = [0.0] * 4
        for i in (1, 2, 3):
            raw = i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i] if n[i] and n[1] + 2 * n[2] else None
            d[i] = raw if raw is not None and 0 < raw < i else 0.5 * i
        total, left = Counter(), Counter()
        for g, v in c.items():
            total[g >> bits] += v
            left[g >> bits] += d[min(v, 3)]
        for g, v in c.items():
            lower = 1 / (kinds + 1) if k == 1 else probability[k - 1, g & ((1 << bits * (k - 1)) - 1)]
            probability[k, g] = (v - d[min(v, 3)]) / total[g >> bits] + left[g >> bits] / total[g >> bits] * lower
    return probability


def test_kneser_ney_equals_the_textbook(spark):
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("aabcde") for _ in range(r.randrange(1, 6))) for _ in range(30)) for _ in range(20)]
    d = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    model = quality_lm.collect_model(quality_lm.kneser_ney(quality_lm.count_grams(d)))
    want = brute_kneser_ney(texts)
    g = np.concatenate([quality_lm.packed(t) for t in texts[:5]])
    found = quality_lm.log_probability(model, "en", g)
    assert np.allclose(found, [math.log(want[5, x]) for x in g.tolist()], atol=1e-4)
    assert np.isnan(quality_lm.log_probability(model, "fr", g[:3])).all()
    unseen = quality_lm.log_probability(model, "en", quality_lm.packed("zzz eda"))
    assert np.isfinite(unseen).all() and unseen[0] < found.mean()


@pytest.mark.parametrize("resident", [1 << 22, 200, 1])
def test_bands_equal_brute_force(spark, resident):
    """Perplexity, quartiles, bands and verdicts; wherever the border between memory and table lies."""
    r, texts = random.Random(12), {}
    for i in range(90):
        lang, letters = ("en", "aabcde") if i % 3 else (None, "uvwxyz")
        texts[i] = lang, " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 7))) for _ in range(r.choice([5, 25, 60, 200])))
    texts |= {100: ("en", "".join(r.choice("zqxj ") for _ in range(400))), 101: ("en", "a " * 60), 102: ("en", None), 103: ("de", "ein Satz steht allein"), 104: ("en", texts[1][1])}
    d = spark.createDataFrame([(i, lang, t) for i, (lang, t) in texts.items()], "doc_id long, lang string, text string")
    got = {x["doc_id"]: x for x in quality_lm.quality(d, resident).collect()}
    assert got.keys() == texts.keys()
    for lang in ("en", None, "de"):
        own = {i: t or "" for i, (k, t) in texts.items() if k == lang}
        probability = brute_kneser_ney([t for t in own.values() if t])
        ppl = {i: -sum(math.log(probability[5, g]) for g in quality_lm.packed(t).tolist()) / len(quality_lm.packed(t)) for i, t in own.items() if t}
        failed = {i: (f := quality_lm.base_figures(t))[0] < 20 or 100 * f[4] > 30 * f[0] for i, t in own.items()}
        ranked = sorted(ppl[i] for i in ppl if not failed[i])
        low, mid, high = (ranked[math.ceil(q * len(ranked)) - 1] for q in (0.25, 0.5, 0.75)) if ranked else (None,) * 3
        for i, t in own.items():
            assert got[i]["base_failed"] == failed[i] and (got[i]["log_ppl"] is None) == (not t)
            if t:
                assert got[i]["log_ppl"] == pytest.approx(ppl[i], abs=1e-4)
            words = quality_lm.WORDS.findall(t)
            slack = quality_lm.SHORT_TEXT / math.sqrt(max(1, sum(map(len, words)) + len(words)))
            if ranked and t:
                band = (mid - quality_lm.BAND * max(mid - low, quality_lm.MIN_SPREAD) - slack, mid + quality_lm.BAND * max(high - mid, quality_lm.MIN_SPREAD) + slack)
                assert (got[i]["band_low"], got[i]["band_high"]) == pytest.approx(band, abs=1e-3)
                if min(abs(ppl[i] - x) for x in band) > 1e-3:
                    assert got[i]["kept"] == (not failed[i] and band[0] <= ppl[i] <= band[1])
            else:
                assert not got[i]["kept"]


def test_sorted_hash_arrays():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 5000):
        keys = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(n % 2))
        keys = r.permutation(np.concatenate([keys, np.array([0, 0xFFFFFFFFFFFFFFFE], np.uint64)])) if n == 5 else r.permutation(keys)
        model = quality_lm.Model(keys, np.arange(len(keys), dtype=float), np.zeros(len(keys)))
        at = model.find(keys)
        assert (at >= 0).all() and np.array_equal(model.logp[at], np.arange(len(keys))) if n else True
        others = np.setdiff1d(np.concatenate([r.integers(0, 1 << 63, 300).astype(np.uint64), np.array([0xFFFFFFFFFFFFFFFF, 1], np.uint64)]), keys)
        assert (model.find(others) == -1).all()


def test_quality_keeps_clean_rows(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("aeiourstln") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(40, 200))), "en") for i in range(200)]
    rows += [(900, None, "en"), (901, "", None), (902, "too few words", "en"), (903, "same words again and here " * 30, "en"), (904, "".join(r.choice("qxzjkvw") + r.choice(" qxzj") for _ in range(900)), "en"), (905, rows[0][1], None)]
    got = {x["doc_id"]: x for x in quality_lm.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["kept"] for i in range(200)) == 200
    assert [got[i]["base_failed"] for i in (900, 901, 902, 903)] == [True] * 4 and got[900]["log_ppl"] is None
    assert not any(got[i]["kept"] for i in (900, 901, 902, 903, 904)) and not got[904]["base_failed"]
    assert quality_lm.quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_audit(spark):
    rows = [(i, f"u{i}", f"page {i} é" * (i % 5)) for i in range(9000)] + [(None, "n", "null id"), (3, "u3", "again"), (70_000, None, None), (70_001, "e", "")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("h", F.lit("clash"))
    assert warc_audit.audit(a, a.repartition(3)).count() == 0
    changed = F.when(F.col("page_id") == 17, "x").when(F.col("page_id") == 70_000, "").otherwise(F.col("html"))
    b = a.where("page_id is null or page_id <> 4096").withColumn("html", changed).unionByName(spark.createDataFrame([(80_000, "new", "new", "c")], "page_id long, url string, html string, h string"))
    got = {r["record_id"]: (r["kind"], r["length"]) for r in warc_audit.audit(a, b).collect()}
    assert {k: v[0] for k, v in got.items()} == {17: "content", 4096: "missing", 70_000: "content", 80_000: "additional"}
    assert got[4096][1] == len(("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: u4096\r\nContent-Length: " + str(len(("page 4096 é" * 1).encode())) + "\r\n\r\n" + "page 4096 é" + "\r\n\r\n").encode())
    assert warc_audit.audit(a.limit(0), a.limit(0)).count() == 0
    assert warc_audit.roots(a).count() == 5


def test_warc_files(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}\r\n\r\né</p>") for i in range(30)]
    warc_audit.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    assert sorted((r["url"], r["html"]) for r in warc_audit.read_warc(spark, str(tmp_path / "w")).collect()) == sorted((u, h) for _, u, h in rows)


def test_damaged_warc_is_reported():
    import gzip

    def record(uri, payload):
        return b"WARC/1.1\r\nWARC-Target-URI: " + uri + b"\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"

    three = [gzip.compress(record(b"u%d" % i, bytes([97 + i]) * 5000)) for i in range(3)]
    broken = bytearray(three[1])
    broken[len(broken) // 2] ^= 0xFF
    got = list(warc_audit.warc_records(three[0] + bytes(broken) + three[2]))
    assert [(u, p) for u, p, d in got if not d and u in ("u0", "u2")] == [("u0", b"a" * 5000), ("u2", b"c" * 5000)] and any(d for *_, d in got)
    cut = list(warc_audit.warc_records(three[0] + three[2][:-30]))
    assert cut[0][2] is None and cut[-1][2] == "truncated member"
    plain = list(warc_audit.warc_records(b"noise\n" + record(b"v", b"x") + b"WARC/1.1\r\nContent-Length: many\r\n\r\n"))
    assert [d for *_, d in plain] == ["no record where one should start", None, "no content length"] and plain[1][:2] == ("v", b"x")
    assert list(warc_audit.warc_records(b"")) == []


def test_audit_of_many_rows_without_an_id(spark):
    a = spark.createDataFrame([(None, "n", f"page {i}") for i in range(500)] + [(1, "u", "x")] * 3, "page_id long, url string, html string")
    assert warc_audit.audit(a, a.repartition(4)).count() == 0
    one = warc_audit.audit(a, a.where("html is null or html <> 'page 7'")).collect()
    assert [(r["record_id"], r["kind"]) for r in one] == [(None, "content")]
    fewer = spark.createDataFrame([(1, "u", "x")], a.schema).unionByName(a.where("page_id is null"))
    assert [r["record_id"] for r in warc_audit.audit(a, fewer).collect()] == [1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    lexicon = {"en": "the of and to in is it that was for with".split(), "fr": "le la les des est une dans pour que avec sur".split()}
    item = words(r, 30, 5000)
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "fr"
        rows.append((i, " ".join(r.choice(lexicon[lang]) + str(r.randrange(50)) * (r.random() < 0.1) for _ in range(80)), lang, "s", 1))
    rows += [(200, rows[5][1], "en", "s", 1), (201, None, None, None, None), (202, "123", "en", "s", 1), (203, rows[7][1] + " " + " ".join(item), "en", "s", 1), (204, rows[9][1] + " at 97.51.17.173 now", "en", "s", 1)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "sentencepiece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    component, _ = brute_components({i: t for i, t, *_ in rows if i not in (201, 202)})
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == set(component.values()) - {203}
    assert not docs.where("text like '%97.51.17.173%'").count()
    final = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in final.collect()} == kept and final.where("not round_trip").count() == 0
