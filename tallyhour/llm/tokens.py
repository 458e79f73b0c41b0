"""Byte-level BPE token counts and ids by a compiled transducer.

The splitting rule of the tokenizer (contractions, letters, numbers, other signs, white space
with a look-ahead) is compiled into one deterministic transducer over character classes. Its
transitions are annotated: with the places where a piece ends, and so with the number of
tokens emitted there, which is that of the closed piece. Texts lie end to end and are cut into chunks of
equal length. Each chunk is first run from every state at once, which gives its state map; the maps compose
by a parallel prefix scan; each chunk is then run once from its true state. The first character of
a text has transitions of its own that forget the state before, so texts do not meet.

Tokens of a piece do not depend on its surroundings, so they are worked out once for each
different piece that a worker meets.

Only the alphabets listed in ``_classes`` are compiled. A text with any other character, or with
the text of a special token, goes whole to the library.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from tallyhour.llm import spans

CHUNK = 64
#: pieces a worker keeps, about 60 MB
_REMEMBERED = 1_500_000

# classes of characters; the letters that contractions are made of have their own
LETTER, STMD, LR, LE, LV, LL, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE = range(11)
_FIRST = 11  # added for the first character of a text
# states
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SHORT = range(11)
#: annotations of a transition: a piece starts at this character, at the one before, or at both
HERE, BEFORE = 1, 2


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point below 0x250, and whether it is compiled at all.

    Latin letters with their extensions only: their properties are the same in every version of
    the Unicode tables.
    """
    import unicodedata

    kinds = np.full(0x250, OTHER, np.uint8)
    for code in range(0x250):
        sign = chr(code)
        group = unicodedata.category(sign)[0]
        if group == "L":
            kinds[code] = LETTER
        elif group == "N":
            kinds[code] = NUMBER
        elif sign.isspace() and code not in (0x1C, 0x1D, 0x1E, 0x1F):
            kinds[code] = WHITE
    for signs, kind in (("stmd", STMD), ("r", LR), ("e", LE), ("v", LV), ("l", LL), ("'", APOSTROPHE), (" ", SPACE)):
        for sign in signs:
            kinds[ord(sign)] = kind
    known = np.ones(0x250, bool)
    known[0x1C:0x20] = False
    return kinds, known


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and annotation."""
    letter = kind in (LETTER, STMD, LR, LE, LV, LL)
    if state == QUOTE and letter:
        if kind == STMD:
            return SHORT, 0
        if kind in (LR, LV, LL):
            return {LR: QUOTE_R, LV: QUOTE_V, LL: QUOTE_L}[kind], 0
        return IN_LETTERS, HERE
    late = 0
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if kind == (LL if state == QUOTE_L else LE):
            return SHORT, 0
        state, late = IN_LETTERS, BEFORE  # no contraction: the letter before starts a piece
    if state == AFTER_SPACE and kind not in (SPACE, WHITE):
        # the last space belongs to what follows
        return (IN_LETTERS if letter else IN_NUMBERS if kind == NUMBER else IN_OTHER), BEFORE
    if state == AFTER_WHITE and kind not in (SPACE, WHITE):
        late = BEFORE  # the last white character stands alone
    if kind in (SPACE, WHITE):
        here = 0 if state in (AFTER_SPACE, AFTER_WHITE) else HERE
        return (AFTER_SPACE if kind == SPACE else AFTER_WHITE), here | late
    if letter:
        return IN_LETTERS, late | (0 if state == IN_LETTERS else HERE)
    if kind == NUMBER:
        return IN_NUMBERS, late | (0 if state == IN_NUMBERS else HERE)
    if state in (IN_OTHER, QUOTE):
        return IN_OTHER, late
    return (QUOTE if kind == APOSTROPHE else IN_OTHER), late | HERE


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and annotation, at ``class * 11 + state``."""
    following, marks = np.zeros((22, 11), np.uint8), np.zeros((22, 11), np.uint8)
    for kind in range(11):
        for state in range(11):
            following[kind, state], marks[kind, state] = _step(state, kind)
            following[kind + _FIRST, state], marks[kind + _FIRST, state] = _step(START, kind)
    return following.reshape(-1), marks.reshape(-1)


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """State map of each chunk; rows are chunks, columns start states."""
    following, _ = transducer()
    state = np.broadcast_to(np.arange(11, dtype=np.uint8), (len(classes), 11)).copy()
    base = np.ascontiguousarray(classes.T).astype(np.uint16) * 11
    for place in range(classes.shape[1]):
        state = following[base[place, :, None] + state]
    return state


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Each map composed with all maps before it, in a logarithmic number of steps."""
    done, reach = maps.copy(), 1
    while reach < len(done):
        # first the maps up to `reach` before, then this one
        done[reach:] = np.take_along_axis(done[reach:], done[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return done


def piece_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Marks, for each character, whether a piece starts there."""
    following, marks = transducer()
    n = len(classes)
    padded = np.full(-(-n // chunk) * chunk, _FIRST + SPACE, np.uint8)
    padded[:n] = classes
    grid = padded.reshape(-1, chunk)
    entry = np.zeros(len(grid), np.uint8)
    entry[1:] = prefix_scan(chunk_maps(grid))[:-1, START]
    found = np.empty_like(grid)
    state, base = entry, np.ascontiguousarray(grid.T).astype(np.uint16) * 11
    for place in range(chunk):
        at = base[place] + state
        found[:, place] = marks[at]
        state = following[at]
    found = found.reshape(-1)
    started = (found & HERE) > 0
    started[:-1] |= (found[1:] & BEFORE) > 0
    started = started[:n]
    # a text that ends inside a contraction not completed: r, v or l is a piece of its own
    last = np.flatnonzero(np.append(classes[1:] >= _FIRST, True))
    kind = classes[last] % _FIRST
    open_end = np.isin(kind, (LR, LV, LL)) & (classes[last] < _FIRST)
    for at in last[open_end]:
        if classes[at - 1] % _FIRST == APOSTROPHE and started[at - 1] and not started[at]:
            started[at] = True
    return started


class PieceTokens:
    """Tokens of pieces by their hash: counts, and places in one array of ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [token["content"].encode() for token in described["added_tokens"]]
        self.encode = self._by_ranks(described) or self._by_library
        self.clear()

    def _by_library(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _by_ranks(self, described: dict):
        """The same merges by a faster library, where the ids of the file are in the order of its merges."""
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(value): value for value in signs}
        byte |= {chr(256 + n): value for n, value in enumerate(sorted(set(range(256)) - set(signs)))}
        special = {token["content"] for token in described["added_tokens"]}
        vocab = {token: at for token, at in described["model"]["vocab"].items() if token not in special}
        merged = [token if isinstance(token, str) else " ".join(token) for token in described["model"]["merges"]]
        if [vocab.get(token.replace(" ", "")) for token in merged] != list(range(256, 256 + len(merged))):
            return None
        ranks = {bytes(byte[sign] for sign in token): at for token, at in vocab.items()}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # in order, with the place of each
        self.at = np.zeros(0, np.int64)
        self.n_ids = 0
        self.counts = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)

    def places(self, hashes: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each hash, given in order and once each; new pieces are tokenized first."""
        if len(self.hashes) > _REMEMBERED:
            self.clear()
        where = np.searchsorted(self.hashes, hashes)
        fresh = np.ones(len(hashes), bool)
        inside = where < len(self.hashes)
        fresh[inside] = self.hashes[where[inside]] != hashes[inside]
        found = np.empty(len(hashes), np.int64)
        found[~fresh] = self.at[where[~fresh]]
        new = np.flatnonzero(fresh)
        if len(new):
            encode = self.encode
            encoded = [encode(data[a:b].decode()) for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum()))
            first = len(self.hashes)
            self.counts = _grown(self.counts, first + len(new))
            self.starts = _grown(self.starts, first + len(new))
            self.ids = _grown(self.ids, self.n_ids + len(flat))
            self.counts[first : first + len(new)] = lengths
            self.starts[first : first + len(new)] = self.n_ids + np.cumsum(lengths) - lengths
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.n_ids += len(flat)
            found[new] = np.arange(first, first + len(new))
            self.hashes = np.insert(self.hashes, where[new], hashes[new])
            self.at = np.insert(self.at, where[new], found[new])
        return found


def _grown(values: np.ndarray, n: int) -> np.ndarray:
    if n <= len(values):
        return values
    out = np.zeros(max(n, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


@lru_cache(maxsize=4)
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of pieces, and a mark for each text that is not compiled."""
    kinds, known = _classes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[lead].astype(np.int64)
    wide = np.flatnonzero(code >= 0x80)
    head = code[wide]
    two = (head >= 0xC2) & (head <= 0xC9)
    code[wide] = np.where(two, ((head & 0x1F) << 6) | (data[np.minimum(lead[wide] + 1, len(data) - 1)] & 0x3F), 0x1C)
    odd_at = lead[~known[code]]
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, odd_at, "right") - 1] = True
    classes = kinds[code]
    first = np.searchsorted(lead, offsets[:-1][offsets[:-1] < offsets[1:]])
    classes[first] += _FIRST
    return lead[piece_starts(classes)], odd


def tokenize(column: pa.Array, path: str, want_ids: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Token count of each text, and the ids of each if wanted."""
    tokens = piece_tokens(path)
    data, offsets = spans.text_bytes(column)
    n = len(column)
    if not len(data):
        return np.zeros(n, np.int64), [np.zeros(0, np.uint32)] * n
    starts, odd = _pieces(data, offsets)
    raw = data.tobytes()
    for special in tokens.special:
        at = raw.find(special)
        while at >= 0:
            odd[np.searchsorted(offsets, at, "right") - 1] = True
            at = raw.find(special, at + 1)
    ends = np.append(starts[1:], len(data))
    if odd.any():
        inside = ~odd[np.searchsorted(offsets, starts, "right") - 1]
        starts, ends = starts[inside], ends[inside]
    hashes, index, inverse = np.unique(spans.span_hash(data, starts, ends), return_index=True, return_inverse=True)
    place = tokens.places(hashes, raw, starts[index], ends[index])[inverse]
    count = tokens.counts[place]
    sums = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=sums[1:])
    first = np.searchsorted(starts, offsets)
    counts = sums[first[1:]] - sums[first[:-1]]
    ids: list[np.ndarray] = []
    if want_ids:
        flat = np.arange(sums[-1]) - np.repeat(sums[:-1] - tokens.starts[place], count)
        flat = tokens.ids[flat]
        ids = [flat[a:b] for a, b in zip(sums[first[:-1]].tolist(), sums[first[1:]].tolist())]
    for row in np.flatnonzero(odd).tolist():
        whole = tokens.tokenizer.encode(column[row].as_py(), add_special_tokens=False).ids
        counts[row] = len(whole)
        if want_ids:
            ids[row] = np.array(whole, np.uint32)
    return counts, ids
