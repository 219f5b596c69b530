"""Byte-pair encoding through a minimal acyclic transducer of frequent words, and decoding."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZERS, VOCABULARY, ArrayMerger, Pieces, gather, load_ranks, pretokens
from .common import batched, buffers, col, mounted, shared_dir, written

#: Words that the lexicon holds, at most: the most frequent ones of the whole corpus. Others are merged exactly.
LEXICON = 1 << 17
#: Occurrences from which a word may enter the lexicon.
FREQUENT = 3


class Lexicon:
    """A minimal acyclic transducer: equal suffixes share states, and the outputs along a word's path add up to its number, which leads to its token ids."""

    PARTS = ("arcs", "target", "output", "final", "first", "ids")

    def __init__(self, **parts: np.ndarray):
        self.arcs, self.target, self.output, self.final, self.first, self.ids = (parts[k] for k in self.PARTS)

    @classmethod
    def build(cls, words: list[str], ranks: dict[bytes, int]) -> Lexicon:
        """Words are added in sorted order; a state whose suffixes are complete is replaced by an equal one that exists already."""
        texts = sorted((w.encode(), w) for w in set(words))
        words = [w for w, _ in texts]
        nexts: list[dict[int, int] | None] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path, last = [0], b""

        def settle(depth: int) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                mark = (final[state], *nexts[state].items())
                same = register.setdefault(mark, state)
                if same != state:
                    nexts[path[-1]][last[len(path) - 1]] = same
                    nexts[state] = None

        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            settle(common)
            for byte in word[common:]:
                nexts.append({})
                final.append(False)
                nexts[path[-1]][byte] = len(nexts) - 1
                path.append(len(nexts) - 1)
            final[path[-1]] = True
            last = word
        settle(0)
        # number the states that are left, and count the words below each
        order, seen, todo = [], {0: 0}, [0]
        while todo:
            state = todo.pop()
            order.append(state)
            for to in nexts[state].values():
                if to not in seen:
                    seen[to] = len(seen)
                    todo.append(to)
        below: dict[int, int] = {}
        stack = [0]
        while stack:
            state = stack[-1]
            missing = [to for to in nexts[state].values() if to not in below]
            if missing:
                stack += missing
                continue
            stack.pop()
            below[state] = final[state] + sum(below[to] for to in nexts[state].values())
        arcs, target, output = [], [], []
        for state in order:
            n = int(final[state])
            for byte in sorted(nexts[state]):
                to = nexts[state][byte]
                arcs.append(seen[state] * 256 + byte)
                target.append(seen[to])
                output.append(n)
                n += below[to]
        by = np.argsort(np.array(arcs, np.int64), kind="stable")
        done = np.zeros(len(seen), bool)
        done[[seen[s] for s in order]] = [final[s] for s in order]
        cut = [pretokens(t) for _, t in texts]
        ids, n = ArrayMerger(ranks).merge([w.encode() for x in cut for w in x])
        return cls(
            arcs=np.array(arcs, np.int64)[by], target=np.array(target, np.int32)[by], output=np.array(output, np.int32)[by], final=done,
            first=np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, cut)])], ids=ids,
        )

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for k in self.PARTS:
            np.save(f"{folder}/{k}.npy", getattr(self, k))

    @classmethod
    def load(cls, folder: str) -> Lexicon:
        """Memory-mapped: the workers of a machine share its pages."""
        return cls(**{k: np.load(f"{folder}/{k}.npy", mmap_mode="r") for k in cls.PARTS})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if it isn't held. All words take a step at a time."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lens) - lens
        state, out = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, step = np.flatnonzero(lens > 0), 0
        out[lens == 0] = 0 if len(self.final) and self.final[0] else -1
        while len(live) and len(self.arcs):
            key = state[live] * 256 + data[first[live] + step]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            out[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.target[at]
            out[live] += self.output[at]
            step += 1
            over = lens[live] == step
            ended = live[over]
            out[ended[~self.final[state[ended]]]] = -1
            live = live[~over]
        if not len(self.arcs):
            out[lens > 0] = -1
        return out


class Encoder:
    """Encodes batches of texts: the words that are new are looked up together, and those that the lexicon lacks are merged together."""

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]):
        self.lexicon, self.merger = lexicon, ArrayMerger(ranks)
        self.pieces = Pieces(self._add, self._reset)
        self._reset()

    def forget(self) -> None:
        self.pieces.forget()

    def _reset(self) -> None:
        self.first, self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _add(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        held = self.lexicon.numbers(raw)
        unseen = np.flatnonzero(held < 0)
        ids, lens = gather(self.lexicon.ids, self.lexicon.first[:-1], np.diff(self.lexicon.first), held[held >= 0])
        size = np.zeros(len(new), np.int64)
        size[held >= 0] = lens
        known = len(ids)
        first = np.cumsum(size) - size
        if len(unseen):
            cut = [pretokens(new[k]) for k in unseen.tolist()]
            distinct = list(dict.fromkeys(chain.from_iterable(cut)))
            number = dict(zip(distinct, range(len(distinct)), strict=True))
            codes = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64)
            symbols, n = self.merger.merge([w.encode() for w in distinct])
            merged, n = gather(symbols, np.cumsum(n) - n, n, codes)
            ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, cut)])]
            size[unseen], first[unseen] = np.diff(ends), known + ends[:-1]
            ids = np.concatenate((ids, merged))
        self.first = np.concatenate((self.first, len(self.ids) + first))
        self.lens = np.concatenate((self.lens, size))
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of rows: lo, hi, all their token ids, and how many each row has."""
        for lo, hi, codes, per_row in self.pieces.codes(array):
            ids, n = gather(self.ids, self.first, self.lens, codes)
            ends = np.concatenate(([0], np.cumsum(n)))
            yield lo, hi, ids, np.diff(ends[np.concatenate(([0], np.cumsum(per_row)))])


class Decoder:
    """Token ids to bytes, for many rows at once."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lens = np.fromiter(map(len, tokens), np.int64, size)
        self.first = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows, and each row's first byte (one more at the end)."""
        data, n = gather(self.data, self.first, self.lens, ids)
        ends = np.concatenate(([0], np.cumsum(n)))
        return data, ends[np.concatenate(([0], np.cumsum(counts)))]


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON, least: int = FREQUENT) -> list[str]:
    """The most frequent words of all texts: at least `least` occurrences, at most `most` words. Words that are about as frequent as each other are all in or all out."""

    # what stands between two spaces, with the space before it, as Pieces has it; counted within tasks before the exchange
    cut = docs.select(F.posexplode(F.split(col(text_col), " ")).alias("pos", "w")).where("NOT w RLIKE '^\\\\s|\\\\s$' AND w <> ''")
    words = cut.select(F.when(F.col("pos") == 0, F.col("w")).otherwise(F.concat(F.lit(" "), "w")).alias("word"))
    counted = written(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least), "words")
    # from the top, as many of sixteen bins to a doubling as hold no more words than are wanted: no sort, no large task
    step = F.floor(F.log2("n") * 16)
    sizes = {r.step: r.words for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    low, room = None, most
    for s in sorted(sizes, reverse=True):
        room -= sizes[s]
        if room < 0:
            break
        low = s
    return [] if low is None else [r.word for r in counted.where(step >= low).select("word").toLocalIterator()]


def lexicon_for(docs: DataFrame, text_col: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> str:
    """The folder, on the shared file system, of the lexicon of docs' frequent words."""
    ranks = load_ranks(path)
    folder = mounted(shared_dir(docs.sparkSession, "lexicon"))
    Lexicon.build(frequent_words(docs, text_col), ranks).save(folder)
    return folder


_OPEN: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def _codec(folder: str, path: str) -> tuple[Encoder, Decoder]:
    if (folder, path) not in _OPEN:
        _OPEN.clear()
        ranks = load_ranks(path)
        _OPEN[folder, path] = Encoder(Lexicon.load(folder), ranks), Decoder(ranks)
    return _OPEN[folder, path]


def _coder(folder: str, path: str) -> Callable[[F.Column], F.Column]:
    @F.arrow_udf("struct<token_ids: array<int>, n_tokens: bigint, round_trip: boolean>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _codec(folder, path)
        for text in texts:
            yield coded(text, encoder, decoder)
        # a worker that idles, or that runs another stage's tasks, needn't hold the words of this one
        encoder.forget()

    def coded(text: pa.Array, encoder: Encoder, decoder: Decoder) -> pa.Array:
        off, data = buffers(text)
        ids, counts, same = [], [], []
        for lo, hi, own, n in encoder.encode(text):
            back, at = decoder.decode(own, n)
            raw, want = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            if len(back) == len(raw) and (at == want).all():
                wrong = np.flatnonzero(back != raw)
                ok = np.ones(hi - lo, bool)
                ok[np.searchsorted(want, wrong, "right") - 1] = False
            else:
                ok = np.array([np.array_equal(back[at[i] : at[i + 1]], raw[want[i] : want[i + 1]]) for i in range(hi - lo)])
            ids.append(own)
            counts.append(n)
            same.append(ok)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        none = text.is_null().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False)), flat)
        return pa.StructArray.from_arrays([lists, pa.array(n, mask=none), pa.array(np.concatenate(same) if same else np.zeros(0, bool), mask=none)], names=["token_ids", "n_tokens", "round_trip"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}", lexicon: str | None = None) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of every row; round_trip says whether the decoded ids give the text's bytes again.

    Words of docs that are frequent over the whole table are compiled into a transducer, which workers map into memory;
    other words are merged exactly, so the ids don't depend on the lexicon. One that lexicon_for made before, of these or
    other documents, may be given. Special tokens in a text are ordinary text.
    A null text has null in all three; an empty one has no ids and round_trip true. Repeated rows give equal rows; null
    ids are carried; an empty table gives no rows. Other columns play no part. Texts of any length are encoded whole.
    """
    run = _coder(lexicon or lexicon_for(docs, text_col, path), path)
    return batched(docs).select(col(id_col).alias("doc_id"), run(col(text_col)).alias("v")).select("doc_id", "v.token_ids", "v.n_tokens", "v.round_trip")


def decode(rows: DataFrame, ids_col: str = "token_ids", out_col: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """rows with the text that each list of token ids stands for, in out_col (replaced if it exists). A null list gives null, an empty one the empty text; bytes that aren't UTF-8 become U+FFFD; a null or unknown id is an error."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        decoder = Decoder(load_ranks(path))
        lists = ids.cast(pa.list_(pa.int32()))
        n = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
        flat = lists.flatten()
        if flat.null_count:
            raise ValueError("a list of token ids holds a null")
        data, at = decoder.decode(flat.to_numpy(zero_copy_only=False).astype(np.int64), n)
        raw = data.tobytes()
        return pa.array([raw[at[i] : at[i + 1]].decode("utf-8", "replace") if lists[i].is_valid else None for i in range(len(n))], pa.string())

    return rows.withColumn(out_col, run(col(ids_col)))


