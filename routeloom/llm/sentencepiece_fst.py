"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compilation.  The model file is read once on the driver.  Two machines are built from it.

* The normaliser has three states (start, behind text, behind spaces) and arcs over runs of
  spaces and of other characters; it writes the dummy prefix, and one space for a run if extra
  spaces are to go.
* The piece machine reads characters and knows all pieces that end behind each.  An arc of piece
  ``b`` leaves the state that piece ``a`` has led to, reads the characters of ``b`` and writes
  its id.  For a unigram model every such arc exists and costs the negated score.  For a BPE
  model it costs 1 and exists only if the merges keep the border between ``a`` and ``b``; a
  sequence whose borders all hold is the merge result itself, since no merge crosses a border
  and so the merges inside each piece run as if alone.  A border is tested by undoing the
  merges of both sides from the last one back (``holds``).  A character that is no piece is read
  by the fallback arc, which writes its UTF-8 bytes as byte pieces, or the unknown id, and costs
  more than a path of pieces for BPE, and what the library charges for unigram models.
* User-defined pieces are matched first, the longest one, and cut the text.

Composition.  Each normalised input is composed with the piece machine as a lattice over
positions and the path of least cost in the tropical semiring is taken: costs are relaxed
position by position.  A position needs one state: in a unigram machine all states behind a
position have the same arcs, and in a BPE machine a prefix has one path only, the merge
result of that prefix.  No piece holds a U+2581 after another character, so the lattice falls
apart at those places.  The distinct parts of a slice of texts are solved on their own, in the
order of sorting, so that the lattice of a common beginning is relaxed once; parts that came more than once are
kept in a dictionary of bounded size.  The parts are local,
hence long texts need no more memory than their result.

Defined results: null and empty texts give no pieces and decode to the empty text; very
long texts are encoded whole; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_text, table

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Longer parts are rare and would make the memo of parts unbounded.
MEMO_CHARS = 64
#: Entries of the memos of parts and of borders, some 300 and 100 bytes each, in one Python worker.
PART_ENTRIES, BORDER_ENTRIES = 200_000, 200_000
#: Bytes of text whose parts are held at a time, some 15 bytes for each.
SLICE_BYTES = 2_000_000
#: Cost of the fallback arc of a BPE model, above the cost of any path of pieces.
FALLBACK_COST = 1e6
#: Fixed value: what the library takes off the least score for an unknown character.
UNKNOWN_PENALTY = 10.0
START, BEHIND_TEXT, BEHIND_SPACES = range(3)
RUNS = re.compile(" +|[^ ]+").findall


def _fields(buf: bytes):
    """(field number, wire type, value) of one protocol-buffer message."""
    i, n = 0, len(buf)

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            b = buf[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < n:
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, wire, varint()
        elif wire == 1:
            i += 8
            yield key >> 3, wire, buf[i - 8 : i]
        elif wire == 2:
            size = varint()
            i += size
            yield key >> 3, wire, buf[i - size : i]
        elif wire == 5:
            i += 4
            yield key >> 3, wire, buf[i - 4 : i]
        else:
            raise ValueError(f"wire type {wire}")


def load_model(path: str) -> dict:
    """Pieces (text, score, type) and the normaliser's and trainer's settings that encoding needs."""
    pieces, out = [], {"model_type": 1, "byte_fallback": False, "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True, "charsmap": b""}
    with open(path, "rb") as f:
        data = f.read()
    for number, _, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, _, v in _fields(value):
                if k == 1:
                    text = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            pieces.append((text, score, kind))
        elif number == 2:
            for k, _, v in _fields(value):
                if k == 3:
                    out["model_type"] = v
                elif k == 35:
                    out["byte_fallback"] = bool(v)
        elif number == 3:
            for k, _, v in _fields(value):
                if k == 2:
                    out["charsmap"] = v
                elif k in (3, 4, 5):
                    out[{3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}[k]] = bool(v)
    if out["charsmap"]:
        raise ValueError("only models whose normaliser has no character map are supported")
    return out | {"pieces": pieces}


class Memo(dict):
    """What ``make`` gives for a key.  With ``limit`` entries it is full and keeps what it has, since the frequent keys come early; after as many keys more it starts anew."""

    def __init__(self, limit: int, make: Callable):
        super().__init__()
        self.limit, self.make, self.missed = limit, make, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        else:
            self.missed += 1
            if self.missed > self.limit:
                self.clear()
                self.missed = 0
        return value


#: Of each position: the machine's node, the least cost, and start and id of the arc that leads there.
Lattice = tuple[list[int], list[float], list[int], list[int]]


def new_lattice() -> Lattice:
    return [0], [0.0], [0], [-1]


def path_of(lattice: Lattice, at: int) -> list[int]:
    """Ids of the arcs on the best path to a position."""
    _, _, came, what = lattice
    out = []
    while at:
        out.append(what[at])
        at = came[at]
    out.reverse()
    return out


class Normaliser:
    """The compiled normaliser; arcs: state -> (written before a run of spaces, for each space, next state), (written before other characters).

    It writes spaces; the piece machine reads them as U+2581, so that texts stay as narrow as they are.
    """

    def __init__(self, model: dict):
        prefix = " " if model["add_dummy_prefix"] else ""
        if model["remove_extra_whitespaces"]:
            # spaces are written by the text behind them, so those at the end never are
            self.spaces = {START: ("", "", START), BEHIND_TEXT: ("", "", BEHIND_SPACES), BEHIND_SPACES: ("", "", BEHIND_SPACES)}
            self.text = {START: prefix, BEHIND_TEXT: "", BEHIND_SPACES: " "}
        else:
            self.spaces = {START: (prefix, " ", BEHIND_SPACES), BEHIND_TEXT: ("", " ", BEHIND_SPACES)}
            self.text = {START: prefix, BEHIND_TEXT: "", BEHIND_SPACES: ""}
            # the states behind the start have the same arcs, which write what they read: one step takes them all
            self.run = lambda text: prefix + text if text else ""

    def run(self, text: str) -> str:
        state, out, spaces, before = START, [], self.spaces, self.text
        for run in RUNS(text):
            if run[0] == " ":
                first, each, state = spaces[state]
                out.append(first + each * len(run))
            else:
                out.append(before[state] + run)
                state = BEHIND_TEXT
        return "".join(out)


class Transducer:
    """The compiled machine; built in each Python worker from the broadcast model."""

    def __init__(self, model: dict):
        self.model = model
        self.bpe = model["model_type"] == 2
        self.normalise = Normaliser(model).run
        self.score = {t: s for t, s, k in model["pieces"] if k == NORMAL}
        self.id = {t: i for i, (t, _, k) in enumerate(model["pieces"]) if k == NORMAL}
        self.unk = next((i for i, (_, _, k) in enumerate(model["pieces"]) if k == UNKNOWN), 0)
        self.byte_id = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(model["pieces"]) if k == BYTE}
        self.unknown_cost = FALLBACK_COST if self.bpe else UNKNOWN_PENALTY - min(self.score.values(), default=0.0)
        self.size = len(model["pieces"])
        self.piece = [t for t, _, _ in model["pieces"]]
        user = {t: array("i", [i]).tobytes() for i, (t, _, k) in enumerate(model["pieces"]) if k == USER_DEFINED and t}
        self.user = user
        self.split_user = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")").split if user else None
        #: when a piece comes about, from the first merge on, and the two that it comes from
        self.time: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        if self.bpe:
            for n, t in enumerate(sorted((t for t in self.score if len(t) > 1), key=lambda t: -self.score[t])):
                self.time[t] = n
            for t in self.time:
                if len(half := self.merges(t, whole=False)) == 2:
                    self.halves[t] = (half[0], half[1])
        #: pieces that tie with another, come about before a half of theirs, or hold such a piece: their borders are tested by merging
        ties = Counter(self.score[t] for t in self.time)
        self.odd = {t for t, n in self.time.items() if ties[self.score[t]] > 1 or any(self.time.get(h, -1) > n for h in self.halves.get(t, ()))}
        for t in sorted(self.halves, key=len):
            if not self.odd.isdisjoint(self.halves[t]):
                self.odd.add(t)
        #: characters inside pieces that are none themselves have ids behind the pieces': merges see them, fallback writes them
        more = sorted({c for t in self.score for c in t} - self.id.keys()) if self.bpe else []
        self.piece += more
        self._compile({**{t: (i, len(t), 1.0 if self.bpe else -self.score[t]) for t, i in self.id.items() if not self.bpe or len(t) == 1 or t in self.halves}, **{c: (self.size + i, 1, self.unknown_cost) for i, c in enumerate(more)}})
        self.size += len(more)
        inner = {c for t in self.score if len(t) > 1 for c in t}
        if any(SPACE in t.lstrip(SPACE) for t in self.score):
            raise ValueError("a piece holds a space mark after another character")
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in inner)
        marks = f" {SPACE}" if model["escape_whitespaces"] else SPACE
        self.parts = re.compile(f"[{marks}]+[^{marks}{alone}]*|[^{marks}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        self.forget()
        self.piece_bytes = []
        for t, _, k in model["pieces"]:
            self.piece_bytes.append(bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode("utf-8"))

    def _compile(self, arcs: dict[str, tuple[int, int, float]]) -> None:
        """The piece machine, read from the left: after each character its node tells all arcs that end there, the longest first."""
        self.child: list[dict[str, int]] = [{}]
        self.fail, ends = [0], {}
        for t, arc in arcs.items():
            node = 0
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.fail.append(0)
                node = self.child[node][c]
            ends[node] = arc
        self.ending: list[tuple] = [()] * len(self.child)
        layer = [0]
        while layer:  # shorter ones first: a node continues the longest proper suffix that is a node
            below = []
            for node in layer:
                for c, to in self.child[node].items():
                    back = self.fail[node]
                    while back and c not in self.child[back]:
                        back = self.fail[back]
                    self.fail[to] = self.child[back].get(c, 0) if node else 0
                    self.ending[to] = ((ends[to],) if to in ends else ()) + self.ending[self.fail[to]]
                    below.append(to)
            layer = below
        none: dict[str, int] = {}
        self.child = [x or none for x in self.child]

    def forget(self) -> None:
        self.memo, self.border = {}, Memo(BORDER_ENTRIES, self.holds)

    def merges(self, text: str, whole: bool = True) -> list[str]:
        """What the merges leave of ``text``: best score first, then leftmost; without ``whole``, before the one that would give all of it."""
        s, score = list(text), self.score
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None or (len(s) == 2 and not whole):
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def holds(self, ends: int) -> bool:
        """Whether the merges keep the border between two pieces (their ids as one number): no merge across it comes before those that it would undo."""
        a, b = map(self.piece.__getitem__, divmod(ends, self.size))
        if a in self.odd or b in self.odd:
            return self.merges(a + b) == [a, b]
        time, halves, before = self.time, self.halves, self.size
        while True:
            across = time.get(a + b)
            if across is not None and across < before:
                return False
            ta, tb = time.get(a, -1), time.get(b, -1)
            if ta > tb:
                before, a = ta, halves[a][1]
            elif tb >= 0:
                # of two like merges the left one comes first
                before, b = tb + 1, halves[b][0]
            else:
                return True

    def _relax(self, text: str, at: int, lattice: Lattice) -> None:
        """Go on with the lattice of a text whose first ``at`` characters it has been relaxed for.

        Costs are relaxed position by position over the arcs that end there.  In a BPE machine one of them leads on a path, so the first that does is the least.
        """
        size, bpe, border, child, fail, ending, unknown = self.size, self.bpe, self.border, self.child, self.fail, self.ending, self.unknown_cost
        nodes, cost, came, what = lattice
        node, end = nodes[at], at
        for c in text[at:]:
            end += 1
            to = child[node].get(c)
            while to is None and node:
                node = fail[node]
                to = child[node].get(c)
            node = to or 0
            if bpe:
                for piece, length, more in ending[node]:
                    start = end - length
                    last = what[start]
                    if last < 0 or border[last * size + piece]:
                        cost.append(cost[start] + more)
                        came.append(start)
                        what.append(piece)
                        break
                else:
                    cost.append(cost[-1] + unknown)
                    came.append(end - 1)
                    what.append(-1)
            else:
                least, start, arc, length = float("inf"), end - 1, -1, 0
                for piece, length, more in ending[node]:
                    if cost[end - length] + more < least:
                        least, start, arc = cost[end - length] + more, end - length, piece
                if length != 1 and cost[-1] + unknown < least:
                    least, start, arc = cost[-1] + unknown, end - 1, -1
                cost.append(least)
                came.append(start)
                what.append(arc)
            nodes.append(node)

    def shortest(self, text: str) -> list[int]:
        """Ids on the path of least cost of ``text`` composed with the machine; -1 stands for the fallback arc of a character in no piece."""
        lattice = new_lattice()
        self._relax(text, 0, lattice)
        return path_of(lattice, len(text))

    def _written(self, text: str, ids: list[int]) -> bytes:
        """Ids as 32-bit integers, with the fallback arcs' bytes."""
        if ids and (min(ids) < 0 or max(ids) >= len(self.piece_bytes)):
            at, out = 0, []
            for i in ids:
                if 0 <= i < len(self.piece_bytes):
                    out.append(i)
                    at += len(self.piece[i])
                    continue
                out += [self.byte_id[b] for b in text[at].encode("utf-8")] if self.byte_id and self.model["byte_fallback"] else [self.unk]
                at += 1
            ids = out
        return array("i", ids).tobytes()

    def solve(self, parts: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each part with its ids.  In the order of sorting neighbours begin alike, and the lattice of what they share is kept."""
        escaped, before, lattice = self.model["escape_whitespaces"], "", new_lattice()
        for part in sorted(parts):
            text = part.replace(" ", SPACE) if escaped else part
            at = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                at += 1
            for column in lattice:
                del column[at + 1 :]
            self._relax(text, at, lattice)
            yield part, self._written(text, path_of(lattice, len(text)))
            before = text

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        if self.split_user is not None:
            return [self._around_user_pieces(t) for t in texts]
        split = [self.parts(self.normalise(t)) for t in texts]
        times, memo = Counter(chain.from_iterable(split)), self.memo
        new = [p for p in times if p not in memo]
        memo.update(self.solve(new))
        out = [b"".join(map(memo.__getitem__, x)) for x in split]
        # what came once, or is long, isn't worth its place
        for p in new if len(memo) > PART_ENTRIES else [p for p in new if times[p] == 1 or len(p) > MEMO_CHARS]:
            del memo[p]
        return out

    def _around_user_pieces(self, text: str) -> bytes:
        plain = self.normalise(text)
        between = self.split_user(plain.replace(" ", SPACE) if self.model["escape_whitespaces"] else plain)  # pieces stand at the odd places
        return b"".join(self.user[x] if i % 2 else b"".join([dict(self.solve([p]))[p] for p in self.parts(x)]) for i, x in enumerate(between))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        out = b"".join(map(self.piece_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.model["add_dummy_prefix"] and out.startswith(" ") else out

    def decode_target(self, text: str) -> str:
        """The text that a faithful round trip gives: normalised, with the space marks read as spaces."""
        out = self.normalise(text).replace(SPACE, " ")
        return out[1:] if self.model["add_dummy_prefix"] and out.startswith(" ") else out


_machines: dict[str, Transducer] = {}


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, n_fallback (byte pieces), ids, and whether decoding the ids gives back the normalised text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))  # bounded by the model file
    token = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if token not in _machines:
            _machines.clear()
            _machines[token] = Transducer(shared.value)
        machine = _machines[token]
        texts = [t or "" for t in batch.column("text").to_pylist()]
        coded = machine.encode_all(texts)
        flat = np.frombuffer(b"".join(coded), np.int32)
        ends = np.cumsum([0] + [len(c) // 4 for c in coded])
        is_byte = np.zeros(len(machine.piece_bytes) + 1, bool)
        is_byte[list(machine.byte_id.values())] = True
        marks = np.concatenate([[0], np.cumsum(is_byte[flat])])
        same = [machine.decode(flat[a:b].tolist()) == machine.decode_target(t) for t, a, b in zip(texts, ends, ends[1:])]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(marks[ends[1:]] - marks[ends[:-1]], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(same, pa.bool_())],
            names=["doc_id", "n_pieces", "n_fallback", "ids", "round_trip"],
        )

    def forget() -> None:
        for machine in _machines.values():
            machine.forget()

    return map_text(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, n_pieces long, n_fallback long, ids array<int>, round_trip boolean", limit=SLICE_BYTES, after=forget)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text that ``ids`` stand for; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model_path))
    token = uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            if token not in _machines:
                _machines.clear()
                _machines[token] = Transducer(shared.value)
            texts = [_machines[token].decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
