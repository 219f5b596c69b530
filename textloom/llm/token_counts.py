"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZERS, VOCABULARY, ArrayMerger, Pieces, load_ranks, pretokens
from .common import batched, col


class Counter:
    """Counts tokens of batches of texts. Each distinct piece is cut into pre-tokens once; a batch's new pre-tokens are merged together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merger = ArrayMerger(ranks)
        self.pieces = Pieces(self._add, self._reset)
        self._reset()

    def _reset(self) -> None:
        self.parts, self.tokens = [], np.zeros(0, np.int64)

    def _add(self, new: list[str]) -> None:
        cut = [pretokens(p) for p in new]
        distinct: dict[str, int] = {}
        codes = np.fromiter((distinct.setdefault(w, len(distinct)) for x in cut for w in x), np.int64)
        _, n = self.merger.merge([w.encode() for w in distinct])
        ends = np.concatenate(([0], np.cumsum(n[codes])))
        self.parts.append(np.diff(ends[np.cumsum([0, *map(len, cut)])]))

    def count(self, array: pa.Array) -> np.ndarray:
        out = np.zeros(len(array), np.int64)
        for lo, hi, codes, per_row in self.pieces.codes(array):
            if self.parts:
                self.tokens = np.concatenate((self.tokens, *self.parts))
                self.parts.clear()
            ends = np.concatenate(([0], np.cumsum(self.tokens[codes])))
            out[lo:hi] = np.diff(ends[np.concatenate(([0], np.cumsum(per_row)))])
        return out


_OPEN: dict[str, Counter] = {}


def _counter(path: str) -> Callable[[F.Column], F.Column]:
    @F.arrow_udf("bigint")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _OPEN:
            _OPEN[path] = Counter(load_ranks(path))
        for text in texts:
            yield pa.array(_OPEN[path].count(text), mask=text.is_null().to_numpy(zero_copy_only=False))
        _OPEN[path].pieces.forget()

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc_id, n_tokens) of every row, for the byte-level vocabulary at path.

    A null text has a null count, an empty one 0. Special tokens in a text are ordinary text. Repeated rows give equal
    rows; null ids are carried; an empty table gives no rows. Other columns play no part. Texts are read whole, however
    long; pre-tokens over bpe.LONG bytes are merged one by one, with the same result.
    """
    run = _counter(path)
    return batched(docs).select(col(id_col).alias("doc_id"), run(col(text_col)).alias("n_tokens"))
