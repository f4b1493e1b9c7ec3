"""Token counts by compiled finite-state transducers.

Two deterministic transducers stand for a byte-level BPE tokenizer:

* ``SPLIT`` reads character classes and marks where pre-tokens begin (letters, digits, others, each
  with one space before them; contractions; white space that leaves its last character to what
  follows). It has 13 states, so what a chunk of text does is a map from 13 states to 13 states.
  Chunks are mapped independently, the maps are composed by a parallel prefix scan, and each chunk
  is then run once from the state that the scan gives it. A document's end is a class of its own
  that leads every state to the start, so chunks need not respect documents.
* ``Merges`` reads the bytes of one pre-token; each transition carries how many tokens the byte adds
  to (or, as merges replace tokens, takes from) the count. A state is the longest vocabulary
  prefix that ends here, with the last token and relative count of each prefix that a later token
  may begin at; that is all that later bytes can depend on, because a sequence of tokens is
  what BPE gives exactly if each two neighbours are what BPE gives for their bytes. States
  are determinised as they are met.

Pre-tokens repeat, so each worker keeps the counts of a bounded number of them.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.arrow import pieces
from quern.llm.packing import _byte_alphabet

#: Character classes. The contraction letters have their own: 's 't 'm 'd, and 're 've 'll.
LETTER, DIGIT, OTHER, BLANK, WHITE, QUOTE, STMD, R, V, L, E, END = range(12)
START, IN_L, IN_D, IN_O, Q, Q_R, Q_V, Q_L, DONE, ONE_B, ONE_W, MORE_B, MORE_W = range(13)
HERE, BACK = 1, 2  # a pre-token begins at this character, at the one before
STATES, CHUNK = 16, 64
#: The White_Space characters of Unicode.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _step(state: int, c: int) -> tuple[int, int]:
    """The next state, and which pre-tokens begin."""
    if c == END:
        return START, BACK if state in (Q_R, Q_V, Q_L) else 0
    letter = c in (LETTER, STMD, R, V, L, E)
    late = 0
    if state == Q:
        if c == STMD:
            return DONE, 0
        if c in (R, V, L):
            return {R: Q_R, V: Q_V, L: Q_L}[c], 0
        state = IN_O
    elif state in (Q_R, Q_V, Q_L):
        if c == (L if state == Q_L else E):
            return DONE, 0
        state, late = IN_L, BACK
    elif state in (MORE_B, MORE_W) and c not in (BLANK, WHITE):
        late = BACK
    if c in (BLANK, WHITE):
        run = state in (ONE_B, ONE_W, MORE_B, MORE_W)
        after = (MORE_B if c == BLANK else MORE_W) if run else (ONE_B if c == BLANK else ONE_W)
        return after, late | (0 if run else HERE)
    joined = state in (ONE_B, MORE_B)
    if letter:
        return IN_L, late | (0 if joined or state == IN_L else HERE)
    if c == DIGIT:
        return IN_D, late | (0 if joined or state == IN_D else HERE)
    if joined or state == IN_O:
        return IN_O, late
    return (Q if c == QUOTE else IN_O), late | HERE


def _tables() -> tuple[np.ndarray, np.ndarray]:
    go, emit = np.zeros((12, STATES), np.uint8), np.zeros((12, STATES), np.uint8)
    for c in range(12):
        for s in range(13):
            go[c, s], emit[c, s] = _step(s, c)
    return go.ravel(), emit.ravel()


GO, EMIT = _tables()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = DIGIT
    table[list(WHITE_SPACE)] = WHITE
    for chars, c in ((" ", BLANK), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(x) for x in chars]] = c
    return table


def states_before(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state before each character: chunk maps, their prefix scan, then each chunk from its known state."""
    n = len(classes)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T).astype(np.int16) * STATES
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in grid:
        maps = GO[column[:, None] + maps]
    reach = 1
    while reach < rows:  # maps[i] becomes what all chunks up to i do
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.concatenate((np.zeros(1, np.uint8), maps[:-1, START]))
    out = np.empty((chunk, rows), np.uint8)
    for i, column in enumerate(grid):
        out[i] = state
        state = GO[column + state]
    return np.ascontiguousarray(out.T).ravel()[:n]


class Merges:
    """The lazily determinised transducer over the bytes of one pre-token."""

    LIMIT = 400_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = [x["content"] for x in spec["added_tokens"]]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.tokens = {t for t in self.tokens if self.merge(t) == [t]}
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.counts: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        #: A state: (longest vocabulary prefix that ends here, for each of its start positions (last token, tokens since)).
        start = (b"", ((b"", 0),))
        #: Each state's node: by byte the next node and the tokens added; at -1 the state itself.
        self.start: dict = {-1: start}
        self.nodes: dict[tuple, dict] = {start: self.start}
        self.counts.clear()

    def merge(self, text: bytes) -> list[bytes]:
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        if not a:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > self.LIMIT:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def move(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The next state and the tokens that the byte adds; tails[j] belongs to the prefix that ends j bytes after the held prefix's start."""
        held, tails = state
        text = held + bytes([byte])
        for j in range(len(text)):
            token = text[j:]
            if token in self.tokens and self.fits(tails[j][0], token):
                break
        added = 1 - tails[j][1]
        tails = (*((t, since + added) for t, since in tails), (token, 0))
        begin = 0
        while text[begin:] not in self.prefixes:
            begin += 1
        return (text[begin:], tails[begin:]), added

    def count(self, word: str) -> int:
        found = self.counts.get(word)
        if found is None:
            if len(self.nodes) > self.LIMIT:
                self.clear()
            elif len(self.counts) > self.LIMIT:
                self.counts.clear()  # walking known nodes again is cheap
            node, found = self.start, 0
            for byte in word.encode():
                if byte not in node:
                    state, added = self.move(node[-1], byte)
                    node[byte] = self.nodes.setdefault(state, {-1: state}), added
                node, added = node[byte]
                found += added
            self.counts[word] = found
        return found


@lru_cache(maxsize=1)
def merges(path: str) -> Merges:
    return Merges(path)


def _cut(texts: list[str], special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts without special strings, whose row each comes from, and the special strings of each row."""
    extra = np.zeros(len(texts), np.int64)
    parts, rows = [], []
    for i, text in enumerate(texts):
        own = [text]
        for s in special:
            if s in text:
                own = [x for part in own for x in part.split(s)]
        extra[i] = len(own) - 1
        parts += own
        rows += [i] * len(own)
    return parts, np.array(rows, np.int64), extra


def count_tokens(texts: list[str], tokenizer: str) -> np.ndarray:
    """Tokens of each text."""
    if not texts:
        return np.zeros(0, np.int64)
    m = merges(tokenizer)
    parts, rows, extra = _cut(texts, m.special)
    joined = "\0".join([*parts, ""])  # a byte for the end of each
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    classes = _classes()[codes]
    classes[ends] = END
    marks = EMIT[classes.astype(np.int16) * STATES + states_before(classes)]
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BACK).astype(bool)
    begins[ends] = True  # closes the last of each text
    at = np.flatnonzero(begins)
    owner = np.searchsorted(ends, at[:-1])
    bounds = at.tolist()
    known, count = m.counts, m.count
    got = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        word = joined[a:b]
        found = known.get(word)
        if found is None:
            found = count(word)
        got.append(found)
    total = extra + np.bincount(rows[owner], got, len(texts)).astype(np.int64)
    return total - np.bincount(rows[:-1], minlength=len(texts))  # each end but the last is a word of one byte


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of each row's whole text.

    Null and empty texts have no tokens; very long ones are counted whole; limit tokens are not over it. Equal ids and repeated rows are counted each on their own;
    other columns are not looked at; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            texts = [x or "" for x in piece.column("text").to_pylist()]
            n = count_tokens(texts, tokenizer)
            size = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
