"""Very long texts and runs: each in seconds, with the results of the plain way."""

import random
import time

import numpy as np
import public_tokenizers
import pytest

from routeloom.llm import decontaminate, pii, token_counts

KEY = b"some key"


@pytest.fixture(autouse=True)
def seconds():
    began = time.thread_time()
    yield
    assert time.thread_time() - began < 30


def test_pii_in_one_long_word():
    p = pii.Pseudonymiser(KEY)
    text = "x" * 1_000_000 + " " + "." * 1_000_000 + "@ " + "a1" * 500_000
    assert p.apply(text) == (text, {})
    new, counts = p.apply("y" * 1_000_000 + " r.23@mail7.example.com")
    assert counts == {"email": 1} and new.startswith("y" * 1_000_000 + " ") and "r.23@" not in new


def test_pii_with_many_values():
    text = " ".join(f"10.{i // 250}.{i % 250}.7 u{i}@mail.org +1 (826) 555-{i % 9000 + 1000}" for i in range(33_000))
    new, counts = pii.Pseudonymiser(KEY).apply(text)
    assert counts == {"ip": 33_000, "email": 33_000, "phone": 33_000} and len(new) == len(text)
    assert pii.Pseudonymiser(KEY, backward=True).apply(new)[0] == text


def test_emails_equal_the_plain_pattern():
    r = random.Random(6)
    for _ in range(3000):
        t = "".join(r.choice(["a", "b.c", "@", "@", ".", "com", ".org", "é", " ", "-", "1", "@x.de"]) for _ in range(r.randrange(1, 14)))
        assert [m.span() for m in pii._emails(t)] == [m.span() for m in pii.KINDS["email"][0].finditer(t)], t


def test_merges_of_long_runs():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    vocab, ranks, specials = token_counts.load_bpe(path)
    counter = token_counts.Counter([], ranks, specials)
    r = random.Random(3)
    texts = ["a" * 50_000, "".join(r.choice("etaoinshr") for _ in range(100_000)), "=" * 30_000, "日本" * 3000, " " * 9999]
    tokenizer = Tokenizer.from_file(path)
    for t in texts:
        assert counter.count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert not any(len(k) > token_counts.MEMO_CHARS for k in counter.memo)
    for _ in range(300):
        s = [r.choice("abcdeth Ġ") for _ in range(r.randrange(2, 90))]
        assert token_counts._merge_count_long(s, ranks) == token_counts.merge_count(s, ranks)


def test_tiling_of_repeated_words(monkeypatch):
    item = ("the of " * 200).split()
    bench = decontaminate.Benchmark([(1, " ".join(item)), (2, "the " * 400), (3, "never found here at all in it")])
    found = decontaminate.match(["the of " * 10_000, "the " * 100_000, None], bench, 0.5)
    assert [{m["item_id"]: m["coverage"] for m in f} for f in found] == [{1: 1.0}, {2: 1.0}, {}]
    monkeypatch.setattr(decontaminate, "SEEDS", 7)
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(60)) for _ in range(20)]
    small = decontaminate.Benchmark([(i, " ".join(r.choice("abc") for _ in range(12))) for i in range(5)])
    cut = decontaminate.match(texts, small, 0.3)
    monkeypatch.setattr(decontaminate, "SEEDS", 1 << 20)
    assert cut == decontaminate.match(texts, small, 0.3) and any(cut)


def test_shared_runs_of_seeds():
    owner, pos, at, length = decontaminate.joined(*(np.array(x) for x in ([0, 0, 0, 1], [5, 6, 9, 7], [1, 2, 5, 3], [1, 1, 1, 1])))
    assert list(zip(owner.tolist(), pos.tolist(), at.tolist(), length.tolist())) == [(0, 5, 1, 2), (0, 9, 5, 1), (1, 7, 3, 1)]
