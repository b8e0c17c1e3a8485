"""Byte-level BPE: encoding and decoding without a regex.

Texts are cut by what their code points are. Every code point has a class, every class
is a function from state to state, and such functions compose associatively, so the
states of a whole slice come from a prefix scan over function numbers: within blocks,
over block totals, and applied again. Where pieces start is then read off states and
neighbours. Pieces go through a cache of merged pairs; their offsets are kept.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import map_slices

BLOCK = 256
CACHE_BYTES = 48 << 20
SHORT, NO_RANK = 64, 1 << 40

# Classes of code points. The last stands between texts.
SPACE, WHITE, NUMBER, OTHER, QUOTE, LETTER, LETTER_1, LETTER_R, LETTER_V, LETTER_L, LETTER_E, RESET = range(12)
# States after a code point: fresh, after a space, after other white space, in a number, in
# other signs, at a quote that may open a suffix, in letters, in the suffixes 'r 'v 'l, at a
# suffix's end.
FRESH, S_SPACE, S_WHITE, S_NUMBER, S_OTHER, S_QUOTE, S_LETTER, S_R, S_V, S_L, S_DONE = range(11)
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = WHITE
    for c, kind in ((" ", SPACE), ("'", QUOTE), ("r", LETTER_R), ("v", LETTER_V), ("l", LETTER_L), ("e", LETTER_E)):
        out[ord(c)] = kind
    out[[ord(c) for c in "stmd"]] = LETTER_1
    return out


def _step(state: int, kind: int) -> int:
    """The state after a code point of this class."""
    if kind == RESET:
        return FRESH
    if kind in (SPACE, WHITE, NUMBER, OTHER):
        return (S_SPACE, S_WHITE, S_NUMBER, S_OTHER)[kind]
    if kind == QUOTE:
        return S_OTHER if state in (S_SPACE, S_OTHER, S_QUOTE) else S_QUOTE
    if state == S_QUOTE:
        return {LETTER_1: S_DONE, LETTER_R: S_R, LETTER_V: S_V, LETTER_L: S_L}.get(kind, S_LETTER)
    if (state, kind) in ((S_R, LETTER_E), (S_V, LETTER_E), (S_L, LETTER_L)):
        return S_DONE
    return S_LETTER


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All functions that classes compose to.

    Returns each class's function number, the flat composition table, the state each
    function takes FRESH to, and the number of functions; the identity is the last one.
    """
    basic = [tuple(_step(s, k) for s in range(11)) for k in range(12)]
    known = {f: i for i, f in enumerate(dict.fromkeys(basic))}
    queue = list(known)
    while queue:
        f = queue.pop()
        for g in basic:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    known.setdefault(tuple(range(11)), len(known))
    every = list(known)
    table = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.int16)
    return np.array([known[f] for f in basic], np.int16), table.ravel(), np.array([f[FRESH] for f in every], np.uint8), len(every)


def states(kinds: np.ndarray) -> np.ndarray:
    """The state after every position, by a prefix scan of function numbers."""
    of_class, compose, from_fresh, n = transitions()
    identity = n - 1
    size = len(kinds)
    width = -(-size // BLOCK)
    functions = np.full(width * BLOCK, identity, np.int16)
    functions[:size] = of_class[kinds]
    steps = np.ascontiguousarray(functions.reshape(width, BLOCK).T).astype(np.int32)
    for i in range(1, BLOCK):  # within all blocks at once
        steps[i] = compose[steps[i - 1] * n + steps[i]]
    before, reach = np.full(width, identity, np.int32), 1
    before[1:] = steps[-1][:-1]
    while reach < width:  # over the totals of blocks
        before[reach:] = compose[before[:-reach] * n + before[reach:]]
        reach *= 2
    return from_fresh[compose[before[None, :] * n + steps]].T.ravel()[:size]


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each position; kinds ends with RESET."""
    after = states(kinds)
    prior = np.empty_like(after)
    prior[0], prior[1:] = FRESH, after[:-1]
    following = np.empty_like(kinds)
    following[-1], following[:-1] = RESET, kinds[1:]
    letter = (kinds >= LETTER) & (kinds <= LETTER_E)
    white = kinds <= WHITE
    sign = (kinds == OTHER) | (kinds == QUOTE)
    in_letters = (prior == S_SPACE) | ((prior >= S_LETTER) & (prior <= S_L))
    opened = (prior == S_QUOTE) & ((after == S_DONE) | ((after >= S_R) & (after <= S_L)))
    start = letter & ~in_letters & ~opened
    start |= (kinds == NUMBER) & (prior != S_SPACE) & (prior != S_NUMBER)
    start |= sign & (prior != S_SPACE) & (prior != S_OTHER) & (prior != S_QUOTE)
    was_white = (prior == S_SPACE) | (prior == S_WHITE)
    start |= white & (~was_white | ((following > WHITE) & (following != RESET)))
    # A suffix that was opened and not finished: the quote stands alone, letters start anew.
    partial = (after >= S_R) & (after <= S_L)
    next_after = np.empty_like(after)
    next_after[-1], next_after[:-1] = FRESH, after[1:]
    start |= partial & (next_after != S_DONE)
    start[kinds == RESET] = True
    return start


class Merges:
    """Ids of pieces: the pair of lowest rank is merged first, the leftmost on ties."""

    def __init__(self, pairs: dict[int, int], single: list[int], last: list[int] | None = None, whole: dict[bytes, int] | None = None):
        """`pairs`: left << 32 | right -> what both become, which is its rank too.

        `single` has the id of each byte, `last` that of a byte that ends its piece, and
        `whole` the pieces that are tokens as they are.
        """
        self.pairs, self.whole = pairs, whole or {}
        self.single, self.last = np.array(single, np.int64), np.array(last or single, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], 1 << 62)
        self.values = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NO_RANK)

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merges:
        """From a rank file: a pair's rank is that of its bytes, however they were merged."""
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        return cls(pairs, [ranks[bytes([b])] for b in range(256)], whole=ranks)

    def _ids(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        ids = self.single[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], NO_RANK)

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """All pieces at once, one merge a round in each; ids as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            rank = self.whole.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > SHORT:
                out[i] = np.array(self._long(self._ids(piece, np.array([len(piece)])).tolist()), "<u4").tobytes()
            else:
                todo.append(i)
        if not todo:
            return out
        sizes = np.array([len(pieces[i]) for i in todo])
        ids = self._ids(b"".join([pieces[i] for i in todo]), np.cumsum(sizes))
        owner = np.repeat(np.arange(len(todo)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            ranks = np.full(len(ids), NO_RANK, np.int64)  # of each id with its right neighbour
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            ranks[inner] = self._ranks(ids[inner], ids[inner + 1])
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(ranks, first)
            lengths = np.diff(np.append(first, len(ids)))
            hits = np.flatnonzero((ranks == np.repeat(least, lengths)) & (ranks != NO_RANK))
            _, leftmost = np.unique(owner[hits], return_index=True)
            hits = hits[leftmost]
            keep = np.ones(len(ids), bool)
            ids[hits] = ranks[hits]
            keep[hits + 1] = False
            ended = np.repeat(least == NO_RANK, lengths)
            done_ids.append(ids[ended])
            done_owner.append(owner[ended])
            keep &= ~ended
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(todo)))).tolist()
        for i, a, b in zip(todo, [0, *ends], ends):
            out[i] = flat[a:b]
        return out

    def _long(self, ids: list[int]) -> list[int]:
        """One piece by a heap over linked neighbours, for pieces without a length bound."""
        rank_of, n = self.pairs.get, len(ids)
        follow, lead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = follow[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            follow[i] = j = follow[j]
            if j < n:
                lead[j] = i
                if (r := rank_of(rank << 32 | ids[j])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := lead[i]) >= 0 and (r := rank_of(ids[k] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, k))
        return [i for i in ids if i >= 0]


class PieceCache:
    """Encoded pieces by their text, in two generations, so that memory stays bounded.

    Once the young generation is full it becomes the old one, and the old one goes;
    a piece found in the old generation moves to the young.
    """

    def __init__(self, merges: Merges):
        self.merges, self.young, self.old, self.held = merges, {}, {}, 0

    def codes(self, pieces: list[str]) -> list[bytes]:
        missing = set(pieces).difference(self.young)
        found = {p: self.old[p] for p in missing if p in self.old}
        new = [p for p in missing if p not in found]
        found.update(zip(new, self.merges.many([p.encode("utf-8") for p in new])))
        self.held += sum(180 + len(p) + len(c) for p, c in found.items())
        self.young.update(found)
        out = list(map(self.young.__getitem__, pieces))
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        return out


class Tokenizer:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.cache = PieceCache(Merges.of_ranks(self.ranks))

    def pieces(self, texts: list[str]) -> list[np.ndarray]:
        """For each text where its pieces start, closed by its length."""
        whole = "\n".join(texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kinds = classes()[points]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds[ends] = RESET
        starts = np.flatnonzero(piece_starts(kinds))
        cuts = np.searchsorted(starts, ends, side="right")
        firsts = np.concatenate(([0], ends[:-1] + 1))
        return [starts[a:b] - f for a, b, f in zip(np.concatenate(([0], cuts[:-1])), cuts, firsts)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
        """Ids (little-endian 32-bit) and piece offsets of each text."""
        offsets = self.pieces(texts)
        cuts = [o.tolist() for o in offsets]
        codes = self.cache.codes([t[a:b] for t, at in zip(texts, cuts) for a, b in zip(at, at[1:])])
        out, k = [], 0
        for at in cuts:
            out.append(b"".join(codes[k : k + len(at) - 1]))
            k += len(at) - 1
        return out, offsets

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encode(tok: Tokenizer, ids: list, texts: list) -> dict:
    codes, offsets = tok.encode(["" if t is None else t for t in texts])
    return {"doc_id": ids, "ids": codes, "offsets": [o.astype("<u4").tobytes() for o in offsets]}


def _decode(tok: Tokenizer, ids: list, codes: list) -> dict:
    return {"doc_id": ids, "decoded": [None if c is None else tok.decode(c) for c in codes]}


def _round_trip(tok: Tokenizer, ids: list, texts: list) -> dict:
    codes, _ = tok.encode(["" if t is None else t for t in texts])
    return {"doc_id": ids, "ids": codes, "decoded": [tok.decode(c) for c in codes]}


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids, offsets): ids and piece starts as little-endian 32-bit numbers.

    `path` names a rank file that every executor can open. Null and empty texts give no
    ids. Every row, repeated or not, gives a row; other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(rows, _encode, "doc_id long, ids binary, offsets binary", 1, partial(Tokenizer, path or default_path()))


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded): the bytes that ids stand for; null ids give null."""
    return map_slices(df.select("doc_id", "ids"), _decode, "doc_id long, decoded binary", 1, partial(Tokenizer, path or default_path()))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): encode and decode in one pass over the texts."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(rows, _round_trip, "doc_id long, ids binary, decoded binary", 1, partial(Tokenizer, path or default_path()))


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")
