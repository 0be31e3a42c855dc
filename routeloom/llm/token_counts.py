"""Token counts with the whole-token shortcut.

A byte-level BPE encodes each pre-token on its own.  For a vocabulary string that the
merges reduce to itself, the count of an equal pre-token is known to be one without
merging.  ``prove_whole_tokens`` runs that proof once, offline, on the driver; workers
count proven pre-tokens by dictionary hit and merge only the others (memoised in a
dictionary of bounded size; long ones with a heap, in n log n steps).

Defined results: null or empty text has 0 bytes and 0 tokens; very long texts are counted
whole; repeated rows give repeated rows; an empty table gives an empty result; other
columns of the input are ignored.  Special strings inside a text are matched first, as the
tokenizer library does by default, and count as one token each.
"""

from __future__ import annotations

import heapq
import json
import uuid

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_text, table

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the memo of merged pre-tokens in one Python worker.
MEMO_ENTRIES = 400_000
#: Longer pre-tokens, in characters, are rare and would make the memo's size unbounded: they are counted each time.
MEMO_CHARS = 64
#: Up to this many symbols, looking through all pairs for each merge is fastest.
SHORT = 100


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of tokens that the merges leave of ``symbols``."""
    if len(symbols) > SHORT:
        return _merge_count_long(symbols, ranks)
    while len(symbols) > 1:
        best, at = None, None
        for pair in zip(symbols, symbols[1:]):
            r = ranks.get(pair)
            if r is not None and (best is None or r < best):
                best, at = r, pair
        if best is None:
            break
        left, right = at
        out, i, n = [], 0, len(symbols)
        while i < n:
            if i + 1 < n and symbols[i] == left and symbols[i + 1] == right:
                out.append(left + right)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return len(symbols)


def _merge_count_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The same with a heap of pairs over a linked list, so that a run of n symbols takes n log n steps."""
    s: list[str | None] = list(symbols)
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((s[i], s[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if s[i] is None or j >= n or ranks.get((s[i], s[j])) != r:
            continue  # one of the two has been merged meanwhile
        s[i], s[j] = s[i] + s[j], None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((s[i], s[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((s[h], s[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return left


def load_bpe(path: str) -> tuple[dict[str, int], dict[tuple[str, str], int], list[str]]:
    """Vocabulary, merge ranks and special strings of a byte-level BPE json file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    specials = [t["content"] for t in spec["added_tokens"]]
    return spec["model"]["vocab"], {m: i for i, m in enumerate(merges)}, specials


def prove_whole_tokens(vocab: dict[str, int], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Vocabulary strings, as texts, that encode alone as one token; strings that are not whole UTF-8 cannot equal a pre-token."""
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    proven = []
    for s in vocab:
        if merge_count(list(s), ranks) == 1:
            try:
                proven.append(bytes(byte_of[c] for c in s).decode("utf-8"))
            except (UnicodeDecodeError, KeyError):
                continue
    return proven


class Memo(dict):
    """Pre-token to token count; proven whole tokens are permanent, the rest bounded."""

    def __init__(self, proven: list[str], ranks: dict[tuple[str, str], int]):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.ranks, self.alphabet = proven, ranks, byte_alphabet()

    def forget(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.proven, 1))

    def __missing__(self, token: str) -> int:
        a = self.alphabet
        n = merge_count([a[b] for b in token.encode("utf-8")], self.ranks)
        if len(token) <= MEMO_CHARS:
            if len(self) > MEMO_ENTRIES + len(self.proven):
                self.forget()
            self[token] = n
        return n


class Counter:
    """Counts tokens of whole texts; one per Python worker."""

    def __init__(self, proven: list[str], ranks: dict[tuple[str, str], int], specials: list[str]):
        self.memo = Memo(proven, ranks)
        self.find = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def count(self, text: str) -> int:
        get = self.memo.__getitem__
        if self.special is None:
            return sum(map(get, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, self.find(p))) for p in parts)


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocab_path: str, context: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    spark = docs.sparkSession
    vocab, ranks, specials = load_bpe(vocab_path)
    shared = spark.sparkContext.broadcast((prove_whole_tokens(vocab, ranks), ranks, specials))  # bounded by the vocabulary file
    token = uuid.uuid4().hex

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        if token not in _counters:
            _counters.clear()
            _counters[token] = Counter(*shared.value)
        counter = _counters[token].count
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n_tokens = [counter(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > context for n in n_tokens], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    def forget() -> None:
        for counter in _counters.values():
            counter.memo.forget()

    return map_text(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", after=forget)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
