"""Token counts by finite-state transducers, without building the tokens.

A byte-level BPE vocabulary is compiled into two deterministic transducers:

* The splitter reads classes of characters and marks where a new word begins.
  A text is cut into chunks of fixed length; each chunk is run from every state
  at once, which gives its state map, and the maps are composed by a parallel
  prefix scan, so each chunk learns the state it is entered in.
* The merger reads the bytes of a word.  Each transition carries the number of
  tokens by which the count of what has been read changes.  Its states are
  made when first met: what has to be known of the past is the longest suffix that
  can still become part of a token, and the last token at each place in it.
  That is enough because a sequence of tokens is the right one exactly if each
  two neighbours alone are kept as they are by the merges.

All work on characters is on arrays; words that were met before are looked up.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 256
TAIL = 16
BATCH_CHARS = 1 << 21
#: Words, transitions and pairs that are kept; beyond it a store is emptied and fills again.
KEPT_WORDS, KEPT_STATES, KEPT_PAIRS = 400_000, 300_000, 400_000

# Symbols and states of the splitter.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LAST_SPACE, LAST_BLANK, RESET = range(9)
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, AFTER_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT, CLOSED = range(10)
# White space as the splitter's pattern has it.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a word begins here" by state and symbol."""
    to, begins = np.zeros((10, 9), np.uint8), np.ones((10, 9), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (SHORT, ONE_LEFT), (LONG, TWO_LEFT), (BLANK, IN_BLANKS), (LAST_SPACE, AFTER_SPACE), (LAST_BLANK, AFTER_BLANK), (RESET, BEGIN)):
        to[:, symbol] = state
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (BLANK, IN_BLANKS)):
        begins[state, symbol] = False
    for symbol in (LETTER, NUMBER, OTHER):
        begins[AFTER_SPACE, symbol] = False
    for symbol in (SHORT, LONG):
        for state in (IN_OTHER, AFTER_SPACE):
            to[state, symbol], begins[state, symbol] = IN_OTHER, False
    to[ONE_LEFT, LETTER], begins[ONE_LEFT, LETTER] = CLOSED, False
    to[TWO_LEFT, LETTER], begins[TWO_LEFT, LETTER] = ONE_LEFT, False
    return to, begins


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK of each code point."""
    major = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    out = np.full(0x110000, OTHER, np.uint8)
    out[np.array([m == "L" for m in major])] = LETTER
    out[np.array([m == "N" for m in major])] = NUMBER
    out[WHITE] = BLANK
    return out


def symbols(codes: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """The splitter's symbol of each character; the characters at `resets` stand between texts."""
    out = _classes()[codes]
    out[resets] = RESET
    after = np.append(out[1:], RESET)
    inner = (out == BLANK) & (after != BLANK) & (after != RESET)
    out[inner] = np.where(codes[inner] == 0x20, LAST_SPACE, LAST_BLANK)
    marks = np.flatnonzero((codes == 0x27) & (out == OTHER))
    if len(marks):
        padded = np.append(codes, [0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        long = (is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[marks] = np.where(is_(one, "stmd"), SHORT, np.where(long, LONG, OTHER))
    return out


def word_starts(symbol: np.ndarray) -> np.ndarray:
    """Where words begin: state maps of chunks, a prefix scan over them, then each chunk from the state it is entered in."""
    to, begins = _splitter()
    next_, begins = (to * np.uint8(to.shape[1])).ravel(), begins.ravel()  # states as offsets of their rows
    width = np.uint8(to.shape[1])
    chunks = max(1, -(-len(symbol) // CHUNK))
    grid = np.full((chunks, CHUNK), RESET, np.uint8)
    grid.ravel()[: len(symbol)] = symbol
    grid = np.ascontiguousarray(grid.T)
    # maps: exit state of each chunk by entry state. If the last few symbols lead all states
    # to one, so does the chunk; only the others are run as a whole.
    every = np.arange(len(to), dtype=np.uint8) * width
    apart, maps = np.arange(chunks), np.empty((chunks, len(to)), np.uint8)
    for begin in (CHUNK - TAIL, 0):
        lanes = np.tile(every, (len(apart), 1))
        for j in range(begin, CHUNK):
            lanes = next_[lanes + grid[j, apart][:, None]]
        maps[apart] = lanes
        apart = apart[(lanes != lanes[:, :1]).any(axis=1)]
    step = 1
    while step < chunks:
        maps[step:] = np.take_along_axis(maps[step:], (maps[:-step] // width).astype(np.intp), axis=1)
        step *= 2
    state = np.append(np.uint8(BEGIN) * width, maps[:-1, BEGIN])
    for j in range(CHUNK):
        grid[j] += state
        state = next_[grid[j]]
    return begins[grid].T.ravel()[: len(symbol)]


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All words of the texts in order, and the number of words of each text."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    resets = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = np.flatnonzero(word_starts(symbols(codes, resets)))
    ends = np.append(starts[1:], len(codes))
    own = np.ones(len(starts), bool)
    own[np.searchsorted(starts, resets)] = False
    starts, ends = starts[own], ends[own]
    counts = np.diff(np.searchsorted(starts, resets), prepend=0)
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())], counts


class Merger:
    """Number of tokens of a word's bytes, by a transducer whose states are made when first met."""

    def __init__(self, tokens: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.tokens, self.ranks = tokens, ranks
        self.prefixes = {t[:i] for t in tokens for i in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        start = (b"", (None,), (0,))
        self.states, self.known, self.moves = [start], {start: 0}, {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merges themselves, on short strings only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _kept(self, left: bytes | None, right: bytes) -> bool:
        key = (left or b"", right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(key[0] + right) == ([left, right] if left else [right])
        return found

    def _move(self, at: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count when a byte is read; states and moves are stored."""
        recent, lasts, counts = self.states[at]
        read = recent + bytes((byte,))
        for begin in range(len(read)):
            token = read[begin:]
            if token in self.tokens and self._kept(lasts[begin], token):
                break
        count = counts[begin] + 1
        lasts, counts = (*lasts, token), (*counts, count)
        cut = next(i for i in range(len(read) + 1) if read[i:] in self.prefixes)
        state = (read[cut:], lasts[cut:], tuple(c - count for c in counts[cut:]))
        to = self.known.setdefault(state, len(self.states))
        if to == len(self.states):
            self.states.append(state)
        self.moves[at << 8 | byte] = to, count
        return to, count

    def count(self, word: bytes) -> int:
        if len(self.states) > KEPT_STATES:
            self._clear()
        moves, at, total = self.moves, 0, 0
        for byte in word:
            move = moves.get(at << 8 | byte)
            at, change = move if move else self._move(at, byte)
            total += change
        return total


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def compiled(path: str) -> tuple[Merger, list[str], dict[str, int]]:
    """The merger of a vocabulary file, its special strings, and the store of counted words."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = [t["content"] for t in spec.get("added_tokens", [])]
    raw = lambda s: bytes(letters[c] for c in s)
    tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return Merger(tokens, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}), special, {}


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text; a special string counts as one and splits the text, as the library has it by default."""
    merger, special, known = compiled(path)
    parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        pieces = [t]
        for s in special:
            pieces = [p for piece in pieces for p in piece.split(s)]
        extra[i] = len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    words, counts = words_of(parts)
    got = list(map(known.get, words))
    if None in got:
        for i, n in enumerate(got):
            if n is None:
                w = words[i]
                n = known.get(w)
                if n is None:
                    n = merger.count(w.encode())
                    if len(w) <= 64:
                        known[w] = n
                got[i] = n
        if len(known) > KEPT_WORDS:
            known.clear()
    sums = np.append(0, np.cumsum(np.array(got, np.int64)))
    ends = np.cumsum(counts)
    per_part = sums[ends] - sums[ends - counts]
    return extra + np.bincount(np.array(owner, int), per_part, len(texts)).astype(np.int64) if texts else extra


def char_batches(texts: list[str], limit: int = BATCH_CHARS):
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > limit:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text; null text counts as empty, with 0 tokens.

    path: a byte-level BPE vocabulary in the tokenizers library's format, at the
    same place on every executor.  Rows with repeated or null ids are counted as
    they stand.
    """

    def count(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            n = [count_tokens(run, path) for run in char_batches(texts)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
