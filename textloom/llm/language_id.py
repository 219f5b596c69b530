"""Language identification by the nearest of several clustered centroids per language."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, batched, buffers, chunks, col, fold, small, written

#: Hashed dimensions of the n-gram space.
DIMS = 4096
#: Texts whose counts are held at a time.
ROWS = 256
#: Different labelled texts of each language that the centroids are fitted on, at most; those with the least hashes.
TRAIN_ROWS = 256
#: Centroids of each language.
CLUSTERS = 4
#: A text is rejected beyond this quantile of the training texts' similarity, less SLACK of it.
QUANTILE, SLACK = 0.002, 0.5
#: Lengths in n-grams from which the radii are learnt, by powers of two.
LENGTHS = tuple(2**k for k in range(3, 15))
REJECTED = "und"

_SPACE = LOWER.copy()
_SPACE[:33] = 32
_SPACE[33:65][~np.isin(np.arange(33, 65), [39])] = 32
_SPACE[91:97] = _SPACE[123:128] = 32


def gram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of the hashed byte 2-grams and 3-grams of each text, without case; all that isn't a letter counts as space, a run of it as one."""
    n = len(off) - 1
    text = _SPACE[fold(data)]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (row[1:] != row[:-1])
    text, row = text[keep].astype(np.uint32), row[keep]
    out = np.zeros(n * DIMS, np.int64)
    for k in (2, 3):
        if len(text) < k:
            continue
        code = text[: len(text) - k + 1].copy()
        for j in range(1, k):
            code = code * np.uint32(256) + text[j : len(text) - k + 1 + j]
        code += np.uint32(k << 28)
        code *= np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        code *= np.uint32(2246822519)
        same = row[: len(code)] == row[k - 1 :]
        out += np.bincount(row[: len(code)][same] * DIMS + (code[same] >> np.uint32(20)), minlength=n * DIMS)
    return out.reshape(n, DIMS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _tf(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts.astype(np.float32))


def kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows; the first centres are far apart."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        centres = unit(np.array([x[at == j].sum(axis=0) if (at == j).any() else centres[j] for j in range(len(centres))], np.float32))
    return centres


@dataclass
class Centroids:
    """idf: weight by dimension. centres: rows of unit length, with the language of each. radius: least accepted similarity by length bucket."""

    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(_tf(counts) * self.idf)

    def classify(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid's number, its cosine similarity, and whether that is within the accepted distance."""
        if not len(self.centres):
            return np.zeros(len(counts), int), np.zeros(len(counts)), np.zeros(len(counts), bool)
        sim = self.vectors(counts) @ self.centres.T
        best = sim.argmax(axis=1)
        top = sim[np.arange(len(sim)), best]
        total = counts.sum(axis=1)
        bucket = np.searchsorted(LENGTHS, total, "right")
        return best, top, (total > 0) & (top >= self.radius[bucket])


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all texts each dimension occurs, and the number of texts. Each task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            off, data = buffers(batch.column(0))
            for lo, hi in chunks(off, rows=ROWS):
                df += (gram_counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) > 0).sum(axis=0)
                n += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array([df]), pa.array([n])], names=["df", "n"])

    each = batched(docs).select(col(text_col)).mapInArrow(run, "df array<bigint>, n bigint")
    got = each.select("n", F.posexplode("df").alias("dim", "df")).groupBy("dim").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIMS)
    df[got["dim"]] = got["df"]
    return df, int(got["n"].max()) if len(got) else 0


@F.arrow_udf(T.StructType([T.StructField("dims", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]))
def _sparse(text: pa.Array) -> pa.Array:
    off, data = buffers(text)
    dims, counts = [], []
    for lo, hi in chunks(off, rows=ROWS):
        for row in gram_counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
            dims.append(np.flatnonzero(row).astype(np.int32))
            counts.append(row[dims[-1]].astype(np.int32))
    return pa.StructArray.from_arrays([pa.array(dims, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["dims", "counts"])


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """(lang, dims, counts) of at most `rows` different labelled texts of each language, those with the least hashes.

    Copies of a text count once, so a language that has any text has a row here, however many copies there are of
    whichever. Ranks are taken within each task before rows are exchanged; what is chosen is bounded by the languages.
    """
    labelled = docs.where(col(lang_col).isNotNull() & (F.trim(col(lang_col)) != "") & (F.length(col(text_col)) > 0))
    hashed = labelled.select(col(lang_col).alias("lang"), F.xxhash64(col(text_col)).alias("h"))
    ranked = hashed.selectExpr("lang", "h", "dense_rank() OVER (PARTITION BY lang ORDER BY h) AS k").where(F.col("k") <= rows)
    chosen = small(written(ranked.select("lang", "h").distinct(), "languages"), 60)
    texts = labelled.select(col(lang_col).alias("lang"), F.xxhash64(col(text_col)).alias("h"), col(text_col).alias("text"))
    once = texts.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return once.select("lang", _sparse("text").alias("v")).select("lang", "v.dims", "v.counts").toPandas()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, clusters: int = CLUSTERS) -> Centroids:
    """Centroids from a bounded labelled sample, with document frequencies of all texts."""
    df, n = document_frequencies(docs, text_col)
    idf = (np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float32)
    sample = labelled_sample(docs, text_col, lang_col, rows).sort_values(["lang"], kind="stable")
    counts = np.zeros((len(sample), DIMS), np.int64)
    for i, (d, c) in enumerate(zip(sample["dims"], sample["counts"], strict=True)):
        counts[i, d] = c
    # the collected order of rows isn't fixed; their content is
    order = sorted(range(len(sample)), key=lambda i: (sample["lang"].iloc[i], counts[i].tobytes()))
    counts, langs = counts[order], [sample["lang"].iloc[i] for i in order]
    centres, names = [np.zeros((0, DIMS), np.float32)], []
    vectors = unit(_tf(counts) * idf)
    for lang in dict.fromkeys(langs):
        own = kmeans(vectors[[x == lang for x in langs]], clusters)
        centres.append(own)
        names += [lang] * len(own)
    model = Centroids(idf, np.vstack(centres), names, np.zeros(len(LENGTHS) + 1))
    if names:
        model.radius = _radii(model, counts)
    return model


def _radii(model: Centroids, counts: np.ndarray, draws: int = 2, seed: int = 11) -> np.ndarray:
    """Least accepted similarity by length: a low quantile over training texts thinned to that length, less the slack; never falling with length beyond what was seen."""
    rng = np.random.default_rng(seed)
    out = np.zeros(len(LENGTHS) + 1)
    totals = counts.sum(axis=1)
    for b, most in enumerate(LENGTHS[1:], 1):
        rows = np.flatnonzero(totals >= LENGTHS[b - 1])
        if len(rows) < 20:
            out[b:] = out[b - 1]
            break
        sims = []
        for i in np.repeat(rows, draws):
            size = min(int(totals[i]), int(rng.integers(LENGTHS[b - 1], most)))
            thin = rng.multinomial(size, counts[i] / totals[i])[None]
            sims.append(float((model.vectors(thin) @ model.centres.T).max()))
        out[b] = np.quantile(sims, QUANTILE) * (1 - SLACK)
    out[len(LENGTHS)] = out[len(LENGTHS) - 1]
    return out


def _classifier(model: Centroids) -> Callable[[F.Column], F.Column]:
    @F.arrow_udf("struct<lang: string, similarity: double>")
    def run(text: pa.Array) -> pa.Array:
        off, data = buffers(text)
        langs, sims = [], []
        for lo, hi in chunks(off, rows=ROWS):
            best, top, ok = model.classify(gram_counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
            langs += [model.languages[b] if k else REJECTED for b, k in zip(best, ok, strict=True)]
            sims.append(top)
        values = np.round(np.concatenate(sims), 3) if sims else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(values.astype(np.float64))], names=["lang", "similarity"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Centroids | None = None) -> DataFrame:
    """(doc_id, predicted, similarity) of every row; predicted is 'und' where the nearest centroid is too far.

    Vectors are normalised log-TF-IDF counts of hashed byte 2-grams and 3-grams; document frequencies are those of the
    whole table, centroids come from at most TRAIN_ROWS different labelled texts of each language. Null and empty texts, and texts
    without n-grams, are rejected with similarity 0. Texts are read whole. Ties go to the language that sorts first.
    Repeated rows give equal rows; null ids are carried; rows with a null or blank lang are classified but not learnt
    from. An empty table gives no rows; a table without labels rejects all. Other columns play no part.
    """
    model = model or fit(docs, text_col, lang_col)
    run = _classifier(model)
    return batched(docs).select(col(id_col).alias("doc_id"), run(col(text_col)).alias("v")).select("doc_id", F.col("v.lang").alias("predicted"), F.col("v.similarity").alias("similarity"))


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", model: Centroids | None = None) -> DataFrame:
    """The rows of docs, with all its columns and their names, but for those that identify rejects.

    Null and empty texts, and texts without n-grams, go. Repeated rows stay or go together; null ids, labels and other
    columns are carried as they are, and none of them decides but lang, which is only learnt from. Long texts are read
    whole. An empty table gives none; of a table without labels nothing stays.
    """
    model = model or fit(docs, text_col, lang_col)
    run = _classifier(model)
    return batched(docs).where(run(col(text_col))["lang"] != REJECTED)
