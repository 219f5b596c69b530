"""Secret scans: a character convolutional network over every candidate and its surroundings."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, batched, buffers, chunks, col

#: Bytes that a candidate consists of, and how many it has at least, a digit and a letter among them.
LEAST = 16
#: Bytes that a value after a telling name and = or : has at least.
LEAST_NAMED = 6
#: The network's window: bytes before the candidate, of it (its two ends, if it is longer), and after it.
BEFORE, INSIDE, AFTER = 32, 64, 16
WIDTH = BEFORE + INSIDE + AFTER
#: Bytes from one window over a long candidate to the next.
STEP = INSIDE // 2
EMBED, FILTERS, KERNEL = 12, 32, 5
#: Labelled findings that the network is fitted on: generated from FITTED_SEED, split into training, calibration and test.
FINDINGS, FITTED_SEED, EPOCHS, BATCH = 6000, 20240501, 12, 64
#: A kind's threshold is the highest at which this share of the calibration set's secrets of that kind is found.
RECALL = 0.99

_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in string.ascii_letters + string.digits + "+/_-=."]] = True
_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = True
NAMES = (b"password", b"passwd", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"access_key", b"secret_key", b"private_key", b"credential", b"auth")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 32, 34, 39]] = True
#: Bytes that end a named value: white space and controls, quotes, comma, semicolon.
_VALUE_END = np.zeros(256, bool)
_VALUE_END[[*range(33), 34, 39, 44, 59]] = True
#: Kinds of candidates; each has a threshold of its own.
BARE, NAMED = 0, 1
_ENDINGS = tuple(n.decode() for n in NAMES)
#: Classes of bytes that the network tells apart: 0 is beyond the text, 1 any that isn't printable ASCII.
_CODE = np.ones(256, np.int64)
_CODE[32:127] = np.arange(2, 97)
CODES = 97


def _named(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the values assigned to telling names, sorted; of values within each other the outermost."""
    none = np.zeros(0, np.int64)
    signs = np.flatnonzero((data == 61) | (data == 58))
    if not len(signs):
        return none, none
    row = np.searchsorted(off, signs, "right") - 1
    begin, stop = off[row], off[row + 1]
    # over at most four blanks back to the name's end, and on to the value's start
    a, b = signs.copy(), signs + 1
    for _ in range(4):
        a -= (a > begin) & _SPACE[data[np.maximum(a - 1, 0)]]
        b += (b < stop) & _SPACE[data[np.minimum(b, len(data) - 1)]]
    telling = np.zeros(len(signs), bool)
    for name in NAMES:
        at = a - len(name)
        fits = np.flatnonzero((at >= begin) & ~telling)
        for k, byte in enumerate(name):
            fits = fits[LOWER[data[at[fits] + k]] == byte]
        telling[fits] = True
    b, stop = b[telling], stop[telling]
    ends = np.flatnonzero(_VALUE_END[data])
    e = np.minimum(np.append(ends, len(data))[np.searchsorted(ends, b)], stop)
    b, e = b[e - b >= LEAST_NAMED], e[e - b >= LEAST_NAMED]
    # values run to the same end if one lies within another, and starts are sorted
    outer = np.r_[True, e[1:] != e[:-1]] if len(e) else np.zeros(0, bool)
    return b[outer], e[outer]


def candidates(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of every candidate, and its kind (BARE: a long run of token bytes; NAMED: a value assigned to a telling name)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    token = _TOKEN[data]
    prev, nxt = np.r_[False, token[:-1]], np.r_[token[1:], False]
    starts = np.flatnonzero(token & (~prev | edge[:-1]))
    ends = np.flatnonzero(token & (~nxt | edge[1:])) + 1
    long = ends - starts >= LEAST
    digits, letters = np.concatenate(([0], np.cumsum(_DIGIT[data]))), np.concatenate(([0], np.cumsum(_LETTER[data])))
    mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
    starts, ends = starts[long & mixed], ends[long & mixed]
    b, e = _named(data, off)
    kinds = np.full(len(starts), BARE)
    if len(b):
        # a run that a named value touches is part of that candidate, unless the network's window doesn't hold the whole of it
        before = np.searchsorted(b, ends, "left")
        reach = np.concatenate(([0], np.maximum.accumulate(e)))
        short = e - b <= INSIDE
        near = np.searchsorted(b[short], ends, "left")
        held = np.concatenate(([0], np.maximum.accumulate(e[short])))[near] > starts if short.any() else np.zeros(len(starts), bool)
        at = np.minimum(np.searchsorted(b, starts), len(b) - 1)
        same = (b[at] == starts) & (e[at] == ends)
        free = (reach[before] <= starts) | ~(held | same)
        starts, ends, kinds = np.concatenate((starts[free], b)), np.concatenate((ends[free], e)), np.concatenate((kinds[free], np.full(len(b), NAMED)))
        order = np.lexsort((ends, starts))
        starts, ends, kinds = starts[order], ends[order], kinds[order]
    return starts, ends, kinds


def encode(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte classes of each candidate's window; a candidate longer than INSIDE shows its first and last halves. Scans show long ones whole, by `pieces`."""
    rows = np.searchsorted(off, starts, "right") - 1
    lo, hi = off[rows][:, None], off[rows + 1][:, None]
    k = np.arange(INSIDE)[None]
    size = (ends - starts)[:, None]
    inner = starts[:, None] + np.where((size > INSIDE) & (k >= INSIDE // 2), size - INSIDE + k, k)
    at = np.hstack([starts[:, None] + np.arange(-BEFORE, 0)[None], inner, ends[:, None] + np.arange(AFTER)[None]])
    seen = (at >= lo) & (at < hi)
    seen[:, BEFORE : BEFORE + INSIDE] &= k < size
    out = np.zeros(at.shape, np.int64)
    out[seen] = _CODE[data[at[seen]]]
    return out


def pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of windows of INSIDE bytes, half of that apart and one at the end, over each candidate longer than that, and the candidate of each."""
    more = -(-np.maximum(ends - starts - INSIDE, 0) // STEP)
    of = np.repeat(np.arange(len(starts)), more + 1)
    k = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    b = np.minimum(starts[of] + k * STEP + INSIDE, ends[of])
    return np.where(more[of] > 0, b - INSIDE, starts[of]), b, of


@dataclass
class Network:
    """Embedding, one convolution with rectifiers, maxima over the three parts of the window, a linear unit; then Platt's scale and each kind's threshold."""

    table: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, float] = (0.5, 0.5)

    PARTS = (slice(0, BEFORE), slice(BEFORE, BEFORE + INSIDE), slice(BEFORE + INSIDE, WIDTH))

    def _forward(self, codes: np.ndarray) -> tuple:
        x = self.table[codes].reshape(len(codes), -1)
        padded = np.pad(x, ((0, 0), (EMBED * (KERNEL // 2), EMBED * (KERNEL // 2))))
        view = np.lib.stride_tricks.sliding_window_view(padded, KERNEL * EMBED, axis=1)[:, ::EMBED]
        act = view @ self.kernel + self.bias
        most = [act[:, p].argmax(axis=1) + p.start for p in self.PARTS]
        pooled = np.stack([np.take_along_axis(act, m[:, None, :], 1)[:, 0] for m in most], 1)
        hidden = np.maximum(pooled, 0)
        return view, most, pooled, hidden, hidden.reshape(len(codes), -1) @ self.out + self.shift

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 256])[-1] for i in range(0, len(codes), 256)]) if len(codes) else np.zeros(0)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.logits(codes) + b)))


def scored(net: Network, data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each candidate's score: of a long one the greatest of its windows and of its two ends together."""
    out = net.scores(encode(data, off, starts, ends))
    long = np.flatnonzero(ends - starts > INSIDE)
    a, b, of = pieces(starts[long], ends[long])
    for lo in range(0, len(a), 4096):
        part = slice(lo, lo + 4096)
        np.maximum.at(out, long[of[part]], net.scores(encode(data, off, a[part], b[part])))
    return out


_PARTS = np.array(["th", "er", "on", "an", "re", "in", "en", "at", "es", "or", "le", "de", "la", "ment", "qui", "ein", "ung", "ció", "que", "str", "ou", "ai", "ch", "ver", "do"])


def _word(rng: np.random.Generator) -> str:
    return "".join(rng.choice(_PARTS, rng.integers(1, 5)))


def _prose(rng: np.random.Generator, n: int) -> str:
    return " ".join(_word(rng) + (rng.choice([".", ",", "", "", "", " |", "###", "!!"])) for _ in range(n))


def _random(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(rng.choice(_letters(alphabet), n))


@lru_cache(maxsize=8)
def _letters(alphabet: str) -> np.ndarray:
    return np.array(list(alphabet))


def labelled_findings(n: int = FINDINGS, seed: int = FITTED_SEED) -> tuple[list[str], list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Texts with a candidate each, its span, whether it is a secret, and its kind; deterministic."""
    rng = np.random.default_rng(seed)
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    names = ("token", "api_key", "apikey", "secret", "password", "passwd", "access_key", "auth_token", "client_secret", "SECRET_KEY", "TOKEN", "API_KEY", "private_key")
    plain = ("commit", "sha1", "md5", "checksum", "digest", "etag", "revision", "build", "id", "uuid", "session", "ref", "image", "file", "version", "order")
    texts, spans, labels, kinds = [], [], np.zeros(n, bool), np.zeros(n, np.int64)
    for i in range(n):
        labels[i] = secret = bool(rng.random() < 0.5)
        quote = str(rng.choice(['"', "'", ""]))
        sign = str(rng.choice([" = ", "=", ": ", " := "]))
        if secret:
            kind = rng.integers(8)
            if kind <= 2:
                value = _random(rng, hexes, int(rng.choice([32, 40, 40, 48, 64])))
            elif kind == 3:
                value = _random(rng, alnum, int(rng.integers(20, 50)))
            elif kind == 4:
                value = str(rng.choice(["AKIA", "ghp_", "sk-", "xoxb-", "glpat-", "AIza"])) + _random(rng, alnum, int(rng.integers(16, 40)))
            elif kind == 5:
                value = _random(rng, alnum + "+/", int(rng.integers(24, 64))) + "=="[: int(rng.integers(0, 3))]
            elif kind == 6:
                value = ".".join(["eyJ" + _random(rng, alnum, 20), "eyJ" + _random(rng, alnum, 40), _random(rng, alnum + "_-", 43)])
            else:
                value = _random(rng, alnum + "!@#%^&*", int(rng.integers(8, 16)))
            value = value.upper() if kind <= 2 and rng.random() < 0.3 else value
            name = str(rng.choice(names)) if kind not in (4, 6) or rng.random() < 0.5 else str(rng.choice(["", "key", "use", "with"]))
            lead = name + sign + quote if name else " "
            kinds[i] = NAMED if name.lower().endswith(_ENDINGS) else BARE
        else:
            kind = rng.integers(8)
            if kind <= 1:
                value, lead = _random(rng, hexes, int(rng.choice([32, 40, 64]))), str(rng.choice(plain)) + str(rng.choice([" ", ": ", "=", " "]))
            elif kind == 2:
                h = _random(rng, hexes, 32)
                value, lead = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", str(rng.choice(plain)) + sign
            elif kind == 3:
                value, lead = f"{_word(rng)}.{int(rng.integers(0, 99)):02d}" + _word(rng) + ".example.com" + _word(rng), " "
            elif kind == 4:
                value = str(rng.choice(["changeme", "your-token-here", "xxxxxxxxxxxxxxxx", "example_password", "<password>", "${API_KEY}", "placeholder123", "none-of-these1", "REDACTED", "********"]))
                lead, kinds[i] = str(rng.choice(names)) + sign + quote, NAMED
            elif kind == 5:
                value, lead = "/".join(_word(rng) for _ in range(4)) + f"/{int(rng.integers(1, 9999))}.html", str(rng.choice(["see ", "path ", "src=", " "]))
            elif kind == 6:
                value, lead = "-".join(_word(rng) for _ in range(4)) + f"-v{int(rng.integers(1, 30))}.{int(rng.integers(0, 30))}", " "
            else:
                value, lead = _word(rng) * 3 + _random(rng, string.digits, int(rng.integers(6, 14))), " "
            quote = quote if lead.endswith(("=", " ")) and quote and lead.endswith(quote) else quote if kind == 4 else ""
        before, after = _prose(rng, int(rng.integers(0, 8))), _prose(rng, int(rng.integers(0, 5)))
        text = before + (" " if before else "") + lead + value + quote + " " + after
        at = len((before + (" " if before else "") + lead).encode())
        texts.append(text)
        spans.append((at, at + len(value.encode())))
    return texts, spans, labels, kinds


def _codes(texts: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    at = np.array(spans).reshape(-1, 2) + off[:-1, None]
    return encode(np.frombuffer(b"".join(raw), np.uint8), off, at[:, 0], at[:, 1])


@lru_cache(maxsize=4)
def train(seed: int = 5, epochs: int = EPOCHS) -> tuple[Network, dict[str, float]]:
    """The network, fitted by Adam on generated labelled findings, scaled and thresholded on the calibration set; measures on the test set. A process fits once for each seed."""
    texts, spans, labels, kinds = labelled_findings()
    codes = _codes(texts, spans)
    a, b = int(0.7 * len(codes)), int(0.85 * len(codes))
    rng = np.random.default_rng(seed)
    first = [rng.normal(0, 0.3, (CODES, EMBED)), rng.normal(0, 0.2, (KERNEL * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS)]
    net = Network(*(x.astype(np.float32) for x in first), 0.0)
    net.table[0] = 0
    slots = ["table", "kernel", "bias", "out"]
    m, v, step = {k: np.float32(0) for k in slots}, {k: np.float32(0) for k in slots}, 0
    for epoch in range(epochs):
        order = rng.permutation(a)
        for at in range(0, a, BATCH):
            pick = order[at : at + BATCH]
            x, y = codes[pick], labels[pick]
            view, most, pooled, hidden, logit = net._forward(x)
            d = ((1 / (1 + np.exp(-logit)) - y) / len(pick)).astype(np.float32)
            dh = (d[:, None] * net.out[None]).reshape(pooled.shape) * (pooled > 0)
            g = {"out": hidden.reshape(len(pick), -1).T @ d, "bias": dh.sum((0, 1)), "kernel": np.zeros_like(net.kernel), "table": np.zeros_like(net.table)}
            row = np.arange(len(pick))[:, None]
            for part in range(3):
                seen = view[row, most[part]]
                g["kernel"] += np.einsum("nfk,nf->kf", seen, dh[:, part])
                back = (dh[:, part][:, :, None] * net.kernel.T[None]).reshape(len(pick), FILTERS, KERNEL, EMBED)
                place = most[part][:, :, None] + np.arange(KERNEL)[None, None] - KERNEL // 2
                inside = (place >= 0) & (place < WIDTH)
                code = np.where(inside, x[row[:, :, None], np.clip(place, 0, WIDTH - 1)], 0)
                slot = code[inside][:, None] * EMBED + np.arange(EMBED)
                g["table"] += np.bincount(slot.ravel(), back[inside].ravel(), CODES * EMBED).reshape(CODES, EMBED).astype(np.float32)
            g["table"][0] = 0
            step += 1
            rate = np.float32(0.004 * (1 - epoch / epochs) + 0.0005)
            net.shift -= float(rate) * float(d.sum()) * 5
            for k in slots:
                m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * g[k]
                v[k] = np.float32(0.999) * v[k] + np.float32(0.001) * g[k] ** 2
                setattr(net, k, getattr(net, k) - rate * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(v[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8)))
    held, y = net.logits(codes[a:b]), labels[a:b].astype(float)
    scale, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(scale * held + shift)))
        scale, shift = scale - 0.05 * float(((p - y) * held).mean()) / max(1.0, float((held**2).mean())) * 4, shift - 0.5 * float((p - y).mean())
    net.scale = (scale, shift)
    score = net.scores(codes[a:b])
    least = []
    for kind in (BARE, NAMED):
        found = np.sort(score[labels[a:b] & (kinds[a:b] == kind)])
        least.append(float(np.floor(found[int((1 - RECALL) * len(found))] * 1e5) / 1e5))
    net.thresholds = (least[0], least[1])
    said, truth = net.scores(codes[b:]) >= np.array(least)[kinds[b:]], labels[b:]
    by_kind = {f"recall_{k}": float(said[truth & (kinds[b:] == i)].mean()) for i, k in enumerate(("bare", "named"))}
    return net, {"recall": float(said[truth].mean()), "precision": float(truth[said].mean())} | by_kind


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: Network | None = None) -> DataFrame:
    """(doc_id, begin, finish, score, is_secret) of every candidate of every document; begin and finish count bytes.

    Candidates are runs of at least LEAST token bytes with a digit and a letter, and values of at least LEAST_NAMED bytes
    that are assigned to a telling name; where such values lie within each other, the outermost is one. is_secret says
    whether the calibrated score reaches its kind's threshold, at which RECALL of the calibration set's secrets of that
    kind are found. Null and empty texts have no candidates. Null ids are carried; repeated rows give
    repeated rows; an empty table gives none. Other columns play no part. Texts are scanned whole, and each candidate is
    found however long it is; one over INSIDE bytes has the greatest score of the network's windows over the whole of it,
    and the runs in a named value of that length are candidates of their own too.
    """
    net = network or train()[0]
    least = np.array(net.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = buffers(batch.column(1))
            rows, begins, finishes, scores, secret = [], [], [], [], []
            for lo, hi in chunks(off):
                d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                a, b, kind = candidates(d, o)
                row = np.searchsorted(o, a, "right") - 1
                rows.append(lo + row)
                begins.append(a - o[row])
                finishes.append(b - o[row])
                scores.append(scored(net, d, o, a, b) if len(a) else np.zeros(0))
                secret.append(scores[-1] >= least[kind])
            if not rows:
                continue
            row, score = np.concatenate(rows), np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(np.concatenate(begins), pa.int64()), pa.array(np.concatenate(finishes), pa.int64()), pa.array(np.round(score.astype(np.float64), 4)), pa.array(np.concatenate(secret))],
                names=["doc_id", "begin", "finish", "score", "is_secret"],
            )

    ids = batched(docs).select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    of = ids.schema["doc_id"].dataType.simpleString()
    return ids.where(col("text").isNotNull()).mapInArrow(run, f"doc_id {of}, begin bigint, finish bigint, score double, is_secret boolean")
