"""What the tokenizer operators share: ranks, pre-tokens, a batch's distinct pieces, exact merging."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .common import buffers, chunks

#: The folder with vocabulary files, and the file used by default. Executors read it too.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text bytes that are cut into pieces at a time, and pieces that a worker remembers.
PIECE_BYTES = 1 << 20
REMEMBER = 300_000
#: Bytes from which a pre-token is merged by itself, with a heap.
LONG = 2048

_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRETOKEN = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Pieces of a text with unusual white space. Python's \s also holds the four separators U+001C to U+001F.
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_PIECE_SLOW = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_SEPARATOR = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pretokens(piece: str) -> list[str]:
    """The pre-tokens of one piece."""
    return _PRETOKEN.findall(piece)


def merge_exactly(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 64:
        return _merge_long(word, ranks)
    cuts = list(range(len(word) + 1))
    none = len(ranks) + 256
    order = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while order:
        low = min(order)
        if low == none:
            break
        i = order.index(low)
        del cuts[i + 1], order[i]
        if i < len(order):
            order[i] = ranks.get(word[cuts[i] : cuts[i + 2]], none)
        if i:
            order[i - 1] = ranks.get(word[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge_exactly with a heap and a linked list, for very long pre-tokens."""
    import heapq

    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class ArrayMerger:
    """Merges many pre-tokens at once, held as one ragged array of symbols.

    In each round every sequence's lowest rank is found, and its pairs of that rank are merged together, leftmost first
    where they overlap; sequences without a pair are done and leave the arrays. Pre-tokens over LONG bytes, whose rounds
    would be many, are merged by themselves.
    """

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        codes, to = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                if a is not None and (b := ranks.get(token[cut:])) is not None:
                    codes.append(a * self.size + b)
                    to.append(rank)
        self.bits = max(10, (4 * len(codes)).bit_length())
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE)
        left, ranked = np.array(codes, np.int64), np.array(to, np.int64)
        at = self._hash(left)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.key[at] < 0
            self.key[at[free]] = left[free]
            placed = self.key[at] == left
            self.rank[at[placed]] = ranked[placed]
            left, ranked, at = left[~placed], ranked[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, codes: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NONE if it has none."""
        at = self._hash(codes)
        key = self.key[at]
        out = np.where(key == codes, self.rank[at], self.NONE)
        todo = np.flatnonzero((key != codes) & (key >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            key = self.key[at[todo]]
            hit = key == codes[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (key >= 0)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive, word after word, and how many each word has."""
        n, rest, done_word, done_sym = len(words), [], [], []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                done_word.append([i])
                done_sym.append([whole])
            elif len(w) > LONG:
                ids = _merge_long(w, self.ranks)
                done_word.append([i] * len(ids))
                done_sym.append(ids)
            else:
                rest.append(i)
        done_word = [np.array([i for x in done_word for i in x], np.int64)]
        done_sym = [np.array([i for x in done_sym for i in x], np.int64)]
        sym = self.byte[np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)]
        word = np.repeat(np.array(rest, np.int64), np.fromiter((len(words[i]) for i in rest), np.int64, len(rest)))
        while len(sym):
            rank = np.full(len(sym), self.NONE)
            rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(sym[:-1] * self.size + sym[1:]), self.NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lens = np.diff(np.r_[first, len(sym)])
            low = np.repeat(np.minimum.reduceat(rank, first), lens)
            over = low == self.NONE
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
                sym, word, rank, low = sym[~over], word[~over], rank[~over], low[~over]
                if not len(sym):
                    break
            chosen = rank == low
            # of a run of chosen pairs, each of which shares a symbol with the next, every other one is merged
            index = np.arange(len(sym))
            begin = chosen & ~np.r_[False, chosen[:-1]]
            chosen &= (index - np.maximum.accumulate(np.where(begin, index, 0))) % 2 == 0
            sym = np.where(chosen, low, sym)
            keep = ~np.r_[False, chosen[:-1]]
            sym, word = sym[keep], word[keep]
        all_word, all_sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(all_word, kind="stable")
        return all_sym[order].astype(np.int32), np.bincount(all_word, minlength=n)


class Pieces:
    """Numbers distinct pieces of texts; `add` is called with the new ones, in order, each time some come.

    No pre-token reaches across two pieces: a text is cut before each space that has other characters than white space
    on both sides. Texts with other spaces than that are cut by a pattern instead.
    """

    def __init__(self, add: Callable[[list[str]], None], reset: Callable[[], None]):
        # a string stands for itself after a space, a tuple for its only element as it is
        self.add, self.reset, self.slot, self.odd = add, reset, {}, set()

    def forget(self) -> None:
        self.slot.clear()
        self.odd.clear()
        self.reset()

    def _learn(self, keys: Iterable[str | tuple[str]]) -> None:
        new = [k for k in dict.fromkeys(keys) if k not in self.slot]
        if new:
            base = len(self.slot)
            self.slot.update(zip(new, range(base, base + len(new)), strict=True))
            for k in new:
                text = k if isinstance(k, str) else k[0]
                if not text or text[0].isspace() or text[-1].isspace():
                    self.odd.add(k)
            self.add([" " + k if isinstance(k, str) else k[0] for k in new])

    def codes(self, array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of rows: lo, hi, the codes of their pieces, and how many each row has. A null counts as an empty text."""
        off, _ = buffers(array)
        for lo, hi in chunks(off, PIECE_BYTES):
            if len(self.slot) > REMEMBER:
                self.forget()
            each = []
            for text in array.slice(lo, hi - lo).to_pylist():
                if text:
                    keys = text.split(" ")
                    keys[0] = (keys[0],)
                    each.append(keys)
                else:
                    each.append([])
            self._learn(k for x in each for k in set(x).difference(self.slot))
            if self.odd:
                for i, x in enumerate(each):
                    if not self.odd.isdisjoint(x):
                        text = array[lo + i].as_py()
                        each[i] = [(p,) for p in (_PIECE_SLOW if _SEPARATOR.search(text) else _PIECE).findall(text)]
                        self._learn(each[i])
            find = self.slot.__getitem__
            yield lo, hi, np.fromiter(map(find, chain.from_iterable(each)), np.int64), np.fromiter(map(len, each), np.int64, len(each))


def gather(values: np.ndarray, first: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[first[c]:first[c]+lens[c]] of the codes, one after another, and each one's length."""
    n = lens[codes]
    total = int(n.sum())
    ends = np.cumsum(n)
    return values[np.arange(total) + np.repeat(first[codes] - (ends - n), n)], n
