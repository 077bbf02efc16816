"""Operator 9: SentencePiece encoding and decoding by weighted transducers.

Three transducers are compiled from a model: the normaliser (a space becomes U+2581, one is put in front), the pieces (a
trie from characters to piece ids, each piece with a weight) and byte fallback (a character without a piece becomes its
UTF-8 bytes). They are composed with an input lazily: `arcs` expands the arcs of one position, and `shortest` finds the
least path in the tropical semiring: weights add up along a path, and a state keeps the least. So the work grows with
the length of the text times that of the longest piece.

The states at a position differ by kind of model. For a unigram model an arc weighs its piece's negative score, and a
position has one state. For a BPE model the score of a path isn't a sum of piece scores: a piece may follow another only
if merging the two together gives these two again, and a sequence whose neighbours all satisfy this is the one that
merging the whole text gives. So a state is the last piece, and an arc weighs 0 where the pair is stable and infinity
where it isn't. Pairs are tried once and remembered.

No piece has a space mark after another character, nor certain other marks after a character that isn't one (which ones
is read off the pieces), so the input is cut before such marks, and each short segment is composed once per worker
and remembered, within a bound in bytes. Models with another normalisation than the identity, without byte fallback or
with a space inside a piece are refused.

Null and empty texts have no ids. Repeated rows are encoded each. Only doc_id and text are read, so further
columns can't clash. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import re
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

SPACE = "▁"
END = ""
#: Bytes that remembered segments take, and pairs that are remembered, until they are forgotten; longer segments aren't remembered.
KNOWN_BYTES, KNOWN_PAIRS, SHORT = 224 << 20, 400_000, 48
#: How much worse than the worst piece a character without one is, in a unigram model.
UNKNOWN = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """Normaliser, pieces and byte fallback, compiled."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_from: int, bpe: bool = True):
        """pieces: (text, score) by id; ids bytes_from to bytes_from + 255 are the bytes; control pieces are empty."""
        self.raw, self.bytes_from, self.bpe = [p.encode() for p, _ in pieces], bytes_from, bpe
        self.raw[bytes_from : bytes_from + 256] = [bytes([b]) for b in range(256)]
        self.score = {p: s for p, s in pieces if p}
        self.id = {p: i for i, (p, _) in enumerate(pieces) if p}
        self.fallback = 0.0 if bpe else UNKNOWN - min(self.score.values(), default=0.0)
        self.trie: dict = {}
        for p in self.id:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[END] = p
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces with a space after another character aren't handled")
        if bpe and any(c not in self.id for p in self.id for c in p if len(p) > 1 and c != SPACE):
            raise ValueError("each character of a BPE piece must be a piece")
        self.stable: dict[str, dict[str, float]] = {}
        self.pairs, self.known, self.known_bytes = 0, {}, 0
        after = {(a, b) for p in self.id for a, b in zip(p, p[1:]) if a != SPACE}
        marks = set("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\n\t")
        while crossed := {b for a, b in after if b in marks and a not in marks}:
            marks -= crossed
        any_ = "".join(map(re.escape, sorted(marks)))
        self.segment = re.compile(f"{SPACE}*[^{SPACE}{any_}]+|{SPACE}*[{any_}]+[^{SPACE}{any_}]*|{SPACE}+" if marks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @staticmethod
    def normalised(text: str) -> str:
        """The first transducer: one state that puts a mark in front, then maps spaces to marks and the rest to itself."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge neighbours, best score first, leftmost of equals, until no more pieces result."""
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def follows(self, a: str, row: dict[str, float], b: str) -> float:
        """Weight of the arc from last piece a (empty: none, or a character without a piece) to b in a BPE model; remembered in a's row."""
        self.pairs += 1
        if self.pairs > KNOWN_PAIRS:
            self.stable.clear()
            self.pairs = 0
        row[b] = found = 0.0 if self.merge([*a, *b]) == ([a, b] if a else [b]) else inf
        return found

    def arcs(self, text: str, i: int) -> list[str]:
        """Labels of the composition's arcs from a position, shortest first: the pieces that begin there and, where its
        character has no piece, that character."""
        node, found, n, j = self.trie, [], len(text), i
        while j < n and (node := node.get(text[j])) is not None:
            if (b := node.get(END)) is not None:
                found.append(b)
            j += 1
        return found if found and len(found[0]) == 1 else [text[i], *found]

    def shortest(self, text: str) -> list[str]:
        """Labels of the least path through the composition of pieces and fallback with a normalised text."""
        return self.finite(text) if self.bpe else self.least(text)

    def least(self, text: str) -> list[str]:
        """By costs: from each position, left to right, its arcs are relaxed."""
        n, score = len(text), self.score
        cost, label = [0.0] + [inf] * n, [""] * (n + 1)
        for i in range(n):
            for b in self.arcs(text, i):
                total = cost[i] + (-score[b] if b in score else self.fallback)
                if total < cost[i + len(b)]:
                    cost[i + len(b)], label[i + len(b)] = total, b
        path = []
        while n:
            path.append(label[n])
            n -= len(label[n])
        return path[::-1]

    def finite(self, text: str) -> list[str]:
        """Where arcs weigh 0 or infinity, any finite path is a least one: the search goes on from the furthest position
        reached. A position that no finite path leads on from is left for good, as just one path reaches it."""
        n, i, last, path, dead, score, stable = len(text), 0, "", [], set(), self.score, self.stable
        options = [self.arcs(text, 0)] if n else []
        while i < n:
            row = stable.get(last)
            if row is None:
                row = stable[last] = {}
            ways = options[-1]
            while ways:
                b = ways.pop()
                if i + len(b) not in dead:
                    if b in score:
                        weight = row.get(b)
                        if weight is None:
                            weight = self.follows(last, row, b)
                    else:
                        weight = 0.0
                    if not weight:
                        path.append(b)
                        i, last = i + len(b), b if b in score else ""
                        if i < n:
                            options.append(self.arcs(text, i))
                        break
            else:
                dead.add(i)
                options.pop()
                i -= len(path.pop())
                last = path[-1] if path and path[-1] in score else ""
        return path

    def compose(self, segment: str) -> list[int]:
        """Ids of a normalised segment; remembered where it is short."""
        ids: list[int] = []
        for b in self.shortest(segment):
            if (known := self.id.get(b)) is not None:
                ids.append(known)
            else:
                ids += (self.bytes_from + x for x in b.encode("utf-8", "surrogatepass"))
        if len(segment) <= SHORT:
            self.known_bytes += 240 + 2 * len(segment) + 8 * len(ids)
            if self.known_bytes > KNOWN_BYTES:
                self.known, self.known_bytes = {}, 0
            self.known[segment] = tuple(ids)
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for segment in self.segment.findall(self.normalised(text)):
            ids += self.known.get(segment) or self.compose(segment)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The inverse: bytes are joined to characters, marks become spaces, the first goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[text.startswith(SPACE) :].replace(SPACE, " ")


@functools.lru_cache(2)
def transducer(path: str) -> Transducer:
    """Compiled from a model file; its pieces are read with the sentencepiece library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    if sp.normalize("ﬁ  a ") != f"{SPACE}ﬁ{SPACE}{SPACE}a{SPACE}" or not any(sp.is_byte(i) for i in range(n)):
        raise ValueError("a model with identity normalisation and byte fallback is needed")
    silent = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    pieces = [("" if silent(i) else sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
    scores = [s for p, s in pieces if p]
    bpe = all(s <= 0 and float(s).is_integer() for s in scores)  # a BPE model numbers its merges; the scores of others are logarithms
    return Transducer(pieces, next(i for i in range(n) if sp.is_byte(i)), bpe)


def encoder(model: str | None = None):
    """Function of a text column that gives the ids of each whole text."""
    path = model or default_model()

    @arrow_udf(ArrayType(IntegerType()))
    def encode(text: pa.Array) -> pa.Array:
        t = transducer(path)
        own = [np.array(t.encode(x.as_py() or ""), np.int32) for x in text]  # 4 bytes an id, not an object
        ends = np.cumsum([0] + [len(x) for x in own]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, np.int32)))

    return encode


def decoder(model: str | None = None):
    """Function of a column of ids that gives the text."""
    path = model or default_model()

    @arrow_udf(StringType())
    def decode(ids: pa.Array) -> pa.Array:
        t = transducer(path)
        return pa.array([t.decode(x.as_py() or []) for x in ids], pa.string())

    return decode
