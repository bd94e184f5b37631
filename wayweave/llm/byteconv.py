"""Language identification by a byte convolutional network, trained here in numpy.

Bytes fall into classes (A-Z as a-z; digits, white space and other ASCII one
class each; every byte beyond ASCII its own). A text is cut into fixed windows
of WINDOW bytes, the last one padded; filters of widths 2, 3 and 4 run over
every position (reading on into the next window), are pooled by their maximum
over the window and end in a softmax over the languages. A document's
probabilities are the softmax of its windows' mean log probabilities, weighted
by length, so the whole text counts.

Training takes at most 1.25 * SAMPLE_ROWS labelled documents, spread evenly over the
languages and picked by a hash of doc_id, and one of every language that these miss, and from each one piece of SAMPLE_CHARS
characters at a hashed place. Rows of null lang, text or doc_id teach nothing.

A null text or one without a letter is `und` with score 0, and so is every text
if no row could be learned from. Of languages of equal probability the alphabetically
first is taken. Very long texts are read slice by slice. Repeated rows are predicted alike; the row
count and all other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import text as tx
from .frames import small

WINDOW = 256
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 16, 12
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 1200
UNKNOWN = "und"
#: Text positions, and windows, handled at once.
SPAN, SLICE = 1 << 16, 4096

_CLASS = np.empty(256, np.int64)
_CLASS[:128] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
_CLASS[48:58] = 1
_CLASS[97:123] = np.arange(4, 30)
_CLASS[65:91] = np.arange(4, 30)
_CLASS[128:] = np.arange(30, 158)
PAD, CLASSES = 0, 158


class ByteConv:
    """Embedding, one bank of filters for each width, and a softmax layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.w = {"e": rng.normal(0, 0.5, (CLASSES, DEPTH)), "v": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "c": np.zeros(len(langs))}
        for k in WIDTHS:
            self.w[f"f{k}"] = rng.normal(0, 1 / np.sqrt(k * DEPTH), (k * DEPTH, FILTERS))
            self.w[f"b{k}"] = np.zeros(FILTERS)
        self._tables = None

    def __getstate__(self):
        return {"langs": self.langs, "w": {k: v.astype(np.float32) for k, v in self.w.items()}, "_tables": None}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on cross entropy. x: rows of WINDOW + 3 classes; y: language numbers."""
        rng, w = np.random.default_rng(seed), self.w
        m, s, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
        share = np.bincount(y, minlength=len(self.langs))
        weight = (len(y) / len(self.langs) / np.maximum(share, 1))[y]
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), size):
                at = order[lo:lo + size]
                g = self._gradients(x[at], y[at], weight[at])
                step += 1
                for k in w:
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.01 * (g[k] ** 2 - s[k])
                    now = rate * (1 - epoch / epochs) + 1e-4
                    w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        self._tables = None

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(y)
        emb = w["e"][x]
        pooled, tops, rows = [], [], np.arange(n)[:, None]
        dead = x[:, :WINDOW] == PAD
        for k in WIDTHS:
            a = sum(emb[:, j:j + WINDOW] @ w[f"f{k}"][j * DEPTH:(j + 1) * DEPTH] for j in range(k)) + w[f"b{k}"]
            a[dead] = -1e9
            top = a.argmax(axis=1)
            tops.append(top)
            pooled.append(a[rows, top, np.arange(FILTERS)[None, :]])
        raw = np.concatenate(pooled, axis=1)
        h = np.maximum(raw, 0)
        z = h @ w["v"] + w["c"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= weight[:, None] / n
        g = {"v": h.T @ p, "c": p.sum(axis=0), "e": np.zeros_like(w["e"])}
        dh = (p @ w["v"].T) * (raw > 0)
        for i, k in enumerate(WIDTHS):
            d = dh[:, i * FILTERS:(i + 1) * FILTERS]
            g[f"b{k}"], f = d.sum(axis=0), np.zeros_like(w[f"f{k}"])
            for j in range(k):
                at = tops[i] + j
                part = w[f"f{k}"][j * DEPTH:(j + 1) * DEPTH]
                f[j * DEPTH:(j + 1) * DEPTH] = np.einsum("nfd,nf->df", emb[rows, at], d)
                np.add.at(g["e"], x[rows, at], d[:, :, None] * part.T[None, :, :])
            g[f"f{k}"] = f
        return g

    def _lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters' outputs for all pairs of classes: of the first two bytes, and of the two after them."""
        if self._tables is None:
            w = {k: v.astype(np.float32) for k, v in self.w.items()}
            part = lambda k, j: w["e"] @ w[f"f{k}"][j * DEPTH:(j + 1) * DEPTH]
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
            first = np.concatenate([pair(part(k, 0), part(k, 1)) + w[f"b{k}"] for k in WIDTHS], axis=1)
            none = np.zeros((CLASSES, FILTERS), np.float32)
            second = np.concatenate([pair(part(3, 2), none), pair(part(4, 2), part(4, 3))], axis=1)
            first[:CLASSES] = -1e9  # the position itself is padding
            self._tables = np.ascontiguousarray(first), np.ascontiguousarray(second)
        return self._tables

    def windows(self, classes: np.ndarray) -> np.ndarray:
        """Log probabilities of windows given as rows of WINDOW + 3 classes."""
        first, second = self._lookup()
        out = []
        step = max(1, SPAN // WINDOW)
        for lo in range(0, len(classes), step):
            x = classes[lo:lo + step]
            pairs = x[:, :-1] * CLASSES + x[:, 1:]
            a = first[pairs[:, :WINDOW]]
            a[:, :, FILTERS:] += second[pairs[:, 2:WINDOW + 2]]
            z = np.maximum(a.max(axis=1), 0) @ self.w["v"].astype(np.float32) + self.w["c"].astype(np.float32)
            z = z - z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text; an empty one gets equal shares."""
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        for lo, hi in tx.blocks(offsets, 1 << 20):
            part = offsets[lo:hi + 1]
            size = np.diff(part)
            n_win = -(-size // WINDOW)
            owner = np.repeat(np.arange(hi - lo), n_win)
            start = part[:-1][owner] + WINDOW * (np.arange(len(owner)) - (np.cumsum(n_win) - n_win)[owner])
            size = np.maximum(size, 1)
            for a in range(0, len(owner), SLICE):
                own, begin = owner[a:a + SLICE], start[a:a + SLICE]
                at = begin[:, None] + np.arange(WINDOW + 3)[None, :]
                stop = part[1:][own]
                cls = np.where(at < stop[:, None], _CLASS[data[np.minimum(at, len(data) - 1)]], PAD)
                share = np.minimum(WINDOW, stop - begin) / size[own]
                np.add.at(total, lo + own, self.windows(cls) * share[:, None])
        p = np.exp(total - total.max(axis=1, keepdims=True, initial=-1e30))
        return p / p.sum(axis=1, keepdims=True)


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list:
    """At most `rows` labelled pieces (lang, piece), about as many for each language."""
    usable = documents.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(8, rows // max(counts.count(), 1))
    shares = counts.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    start = F.lit(1) + F.floor(place * 7919 % 1 * F.greatest(F.length("text") - chars, F.lit(0)))
    pieces = usable.select("doc_id", "lang", place.alias("place"), F.substring("text", start.cast("int"), F.lit(chars)).alias("piece"))
    order = F.struct(F.xxhash64(F.lit(1), "doc_id").alias("h"), "doc_id", "piece")
    picked = pieces.join(small(shares), "lang").where("place < share").select("lang", order.alias("o")).orderBy("o", "lang").limit(rows + rows // 4)
    least = pieces.groupBy("lang").agg(F.min(order).alias("o"))  # one of every language at least
    return picked.unionByName(least).distinct().select("lang", "o.piece").collect()


def fit(documents: DataFrame, rows: int = SAMPLE_ROWS) -> ByteConv | None:
    """A network trained on the documents that are not held out; None if there are none with a label."""
    found = sample(documents, rows)
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return None
    x, y, rng = [], [], np.random.default_rng(3)
    for r in sorted(found, key=tuple):
        raw = np.frombuffer(r["piece"].encode("utf-8", "replace"), np.uint8)
        cuts = range(0, max(1, len(raw)), WINDOW * 2)
        for lo in [*cuts, *rng.integers(0, max(1, len(raw)), 1)]:
            size = WINDOW if rng.random() < 0.6 else int(rng.integers(8, WINDOW))
            row = np.full(WINDOW + 3, PAD, np.int64)
            part = _CLASS[raw[lo:lo + (WINDOW + 3 if size == WINDOW else size)]]
            row[:len(part)] = part
            if len(part):
                x.append(row)
                y.append(langs.index(r["lang"]))
    net = ByteConv(langs)
    if x:
        net.train(np.array(x), np.array(y))
    return net


def predict(text: str | Column, net: ByteConv | None) -> Column:
    """Struct (lang, score) for a text column."""
    col = F.col(text) if isinstance(text, str) else text
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if net is None:
        return unknown

    @arrow_udf("lang string, score double")
    def run(texts: pa.Array) -> pa.Array:
        p = net.probabilities(*tx.utf8(texts))
        best = p.argmax(axis=1)
        names = pa.array(net.langs, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(p[np.arange(len(p)), best].astype(np.float64))], names=["lang", "score"])

    return F.when(F.coalesce(col.rlike(r"\p{L}"), F.lit(False)), run(col)).otherwise(unknown)


def known_language(documents: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents (all their columns) whose language is known with a score of `least` or more."""
    tx.small_batches(documents.sparkSession)
    guess = predict("text", fit(documents))
    return documents.withColumn("__guess", guess).where(f"__guess.lang <> '{UNKNOWN}' and __guess.score >= {least}").drop("__guess")
