"""Document fingerprints by randomised edit embedding.

A text is walked from left to right: at step j the character under the pointer
is written out, and the pointer moves on if a random bit shared by all texts,
R(j, character), is 1. Walks of two texts that differ by an edit fall into step
again after it, so edit distance turns into Hamming distance of the outputs.
Texts are walked in chunks of CHUNK characters, so that the chunks of all
documents are walked side by side and a very long text doesn't hold up the others.
Shifts of up to about the root of CHUNK are forgiven, in each chunk anew.

The output is bit-sampled: at fixed steps, 4 hashed bits of the character are
kept as a hex digit 1 to f, or 0 past the end of the chunk. The first chunk keeps
144 digits, dense at its start for short texts, each further chunk 128. The
likeness of two fingerprints is the share of equal digits, weighted by the steps
that each one stands for, where not both are 0; it is 1 for two empty texts.

Near texts share a band: a few digits sampled within the text's own length (and
within the next lower grade of lengths, where a near text may be that short), of
every chunk. Members of a band's bucket are verified by their likeness against
leaders, then, where these leave texts apart, against each other (banding.classes, bucket by bucket).

A null text is empty. Equal texts have equal fingerprints. A null doc_id comes
first. Repeated doc_ids are ordered by a hash of the text; equal rows, each the next one
of the one before it, are computed once and spread again. Very long texts take one task a
text, their chunks side by side. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import text as tx
from .banding import Likeness, classes
from .frames import BESIDE_TEXTS, small, stash, width

CHUNK = 8192
STEPS = 3 * CHUNK
HEAD, TAIL = 144, 128
#: Characters walked at once.
BLOCK_CHARS = 6_000_000
NEAR = 0.8
BANDS, TAIL_BANDS, DIGITS = 14, 4, 9
#: Grades of lengths, as live digits of a chunk.
HEAD_GRADES, TAIL_GRADES = (1, 2, 4, 8, 16, 32, 48, 80, 144), (32, 64, 128)
NO_ID = -(2**63)
#: Equal rows that one task spreads at once, and rows sampled for each range's border.
SPREAD_ROWS, BORDER_ROWS = 10_000, 100
_U = np.uint64

_rng = np.random.default_rng(20240607)
_MOVE = _rng.integers(0, 2, (STEPS, 256), dtype=np.uint8)


def _strata(edges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """One step drawn from each stratum (start, end, width), and the widths."""
    at, w = [], []
    for lo, hi, by in edges:
        at += [s + int(_rng.integers(0, by)) for s in range(lo, hi, by)]
        w += [by] * len(range(lo, hi, by))
    return np.array(at), np.array(w, np.float64)


_HEAD_AT, _HEAD_W = _strata([(0, 64, 4), (64, 256, 12), (256, 1024, 48), (1024, 4096, 96), (4096, STEPS, 320)])
_TAIL_AT, _TAIL_W = _strata([(0, STEPS, STEPS // TAIL)])
_DIGIT = {int(s): np.frombuffer(b"123456789abcdef", np.uint8)[_rng.integers(0, 15, 256)] for s in sorted({*_HEAD_AT, *_TAIL_AT})}


def _sampled(grade: int, weights: np.ndarray, bands: int) -> np.ndarray:
    """Places of the digits of each band within the first `grade` digits."""
    n = DIGITS if grade >= 16 else max(1, grade * 3 // 4)
    p = weights[:grade] ** 0.5 / (weights[:grade] ** 0.5).sum()
    return np.array([np.sort(_rng.choice(grade, n, replace=False, p=p)) for _ in range(min(bands, grade))])


_HEAD_BANDS = [_sampled(g, _HEAD_W, BANDS) for g in HEAD_GRADES]
_TAIL_BANDS = [_sampled(g, _TAIL_W, TAIL_BANDS) for g in TAIL_GRADES]


def _classes(texts: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _walk(cls: np.ndarray, begin: np.ndarray, end: np.ndarray, head: np.ndarray) -> list[bytes]:
    """The digits of chunks cls[begin:end]."""
    heads = np.full((len(begin), HEAD), 48, np.uint8)
    tails = np.full((len(begin), TAIL), 48, np.uint8)
    cls = np.append(cls, np.uint8(0))
    pos, stop, who = begin.astype(np.int64), end.astype(np.int64), np.arange(len(begin))
    at_head = {int(s): i for i, s in enumerate(_HEAD_AT)}
    at_tail = {int(s): i for i, s in enumerate(_TAIL_AT)}
    for j in range(STEPS):
        if j % 128 == 0:
            live = pos < stop
            pos, stop, who = pos[live], stop[live], who[live]
            if not len(pos):
                break
        c = cls[pos]
        for found, out in ((at_head.get(j), heads), (at_tail.get(j), tails)):
            if found is not None:
                live = pos < stop
                out[who[live], found] = _DIGIT[j][c[live]]
        pos += _MOVE[j][c]
        np.minimum(pos, stop, out=pos)
    return [(heads if h else tails)[i].tobytes() for i, h in enumerate(head)]


def _chunked(texts: list[str], skip: list[int]) -> list[list[bytes]]:
    """Digits of the chunks of each text from chunk `skip` on."""
    parts = [t[k * CHUNK:] for t, k in zip(texts, skip, strict=True)]
    size = np.array([len(p) for p in parts])
    n = np.maximum(-(-size // CHUNK), [k == 0 for k in skip]).astype(np.int64)
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(parts)), n)
    nth = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    begin = base[owner] + nth * CHUNK
    end = np.minimum(begin + CHUNK, (base + size)[owner])
    digits = _walk(_classes(parts), begin, end, (nth == 0) & (np.array(skip, np.int64)[owner] == 0))
    cuts = np.cumsum(n)[:-1]
    return [digits[a:b] for a, b in zip([0, *cuts], [*cuts, len(digits)], strict=True)] if len(parts) else []


def fingerprints(texts: list[str]) -> list[str]:
    return [b"".join(x).decode() for x in _chunked(texts, [0] * len(texts))]


def likeness(one: str, two: str) -> float:
    a, b = np.frombuffer(one.encode(), np.uint8), np.frombuffer(two.encode(), np.uint8)
    n = max(len(a), len(b))
    w = np.concatenate([_HEAD_W, np.tile(_TAIL_W, (n - HEAD) // TAIL)])
    a, b = (np.concatenate([x, np.full(n - len(x), 48, np.uint8)]) for x in (a, b))
    w = w * ((a != 48) | (b != 48))
    total = w.sum()
    return float((w * (a == b)).sum() / total) if total else 1.0


def _chunk_bands(digits: np.ndarray, nth: np.ndarray, grades: tuple[int, ...], places: list[np.ndarray], steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all bands of rows of digits, each the nth chunk of its text."""
    dead = digits == 48
    live = np.where(dead.any(axis=1), dead.argmax(axis=1), digits.shape[1])
    grade = np.searchsorted(grades, live, "right") - 1
    size = steps[np.maximum(live, 1) - 1] * NEAR
    rows, keys = [], []
    for g, at in enumerate(places):
        # a text of a grade, or one just above it, whose near texts may be in it
        above = (grade == g + 1) & (size < steps[grades[min(g + 1, len(grades) - 1)] - 1])
        mine = np.flatnonzero((grade == g) | above)
        for i, band in enumerate(at):
            key = tx.mix(nth[mine].astype(_U) + _U((g * 64 + i + 1 << 32) + len(grades)))
            for d in band:
                key = tx.mix(key ^ digits[mine, d].astype(_U))
            rows.append(mine)
            keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def bands_of(prints: list[str]) -> list[np.ndarray]:
    """Keys of all bands of each fingerprint."""
    raw = [np.frombuffer(p.encode(), np.uint8) for p in prints]
    heads = np.array([r[:HEAD] for r in raw]).reshape(-1, HEAD)
    more = np.array([(len(r) - HEAD) // TAIL for r in raw], np.int64)
    tails = np.concatenate([r[HEAD:] for r in raw] or [np.zeros(0, np.uint8)]).reshape(-1, TAIL)
    owner = np.repeat(np.arange(len(raw)), more)
    nth = np.arange(len(owner)) - (np.cumsum(more) - more)[owner] + 1
    a, key_a = _chunk_bands(heads, np.zeros(len(raw), np.int64), HEAD_GRADES, _HEAD_BANDS, _HEAD_AT)
    b, key_b = _chunk_bands(tails, nth, TAIL_GRADES, _TAIL_BANDS, _TAIL_AT)
    who, keys = np.concatenate([a, owner[b]]), np.concatenate([key_a, key_b]).view(np.int64)
    order = np.argsort(who, kind="stable")
    return np.split(keys[order], np.cumsum(np.bincount(who, minlength=len(raw)))[:-1]) if len(raw) else []


def edited(text: str, following: str) -> str:
    """text, its last floor(n / 4) characters replaced by the first as many (or all) of the following one."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def _rows(rows: list[tuple[int | None, str, int]], after: str) -> dict[str, list]:
    """Result columns of rows (doc_id, text, copies), in order; after: the text that follows."""
    texts = [t for _, t, _ in rows]
    prints = [b"".join(x).decode() for x in _chunked([*texts, after], [0] * (len(texts) + 1))]
    # each row's last copy is followed by the next row, its other copies by themselves
    jobs = [(i, i + 1, 1) for i in range(len(texts))] + [(i, i, n - 1) for i, (_, _, n) in enumerate(rows) if n > 1]
    follows = [*texts, after]
    changed = [edited(texts[i], follows[j]) for i, j, _ in jobs]
    same = [(len(texts[i]) - len(texts[i]) // 4) // CHUNK for i, _, _ in jobs]
    rest = _chunked(changed, same)
    kept = [HEAD + (k - 1) * TAIL if k else 0 for k in same]
    other = [prints[i][:k] + b"".join(r).decode() for (i, _, _), k, r in zip(jobs, kept, rest, strict=True)]
    return {
        "doc_id": [rows[i][0] for i, _, _ in jobs], "n_chars": [len(texts[i]) for i, _, _ in jobs],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [prints[i] for i, _, _ in jobs], "edited_fingerprint": other,
        "near_edited": [likeness(prints[i], e) for (i, _, _), e in zip(jobs, other, strict=True)],
        "near_next": [likeness(prints[i], prints[j]) for i, j, _ in jobs],
        "copies": [n for _, _, n in jobs],
    }


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("copies", pa.int64())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, str, int]] = []
    chars, after = 0, None
    for batch in batches:
        for ahead, key, copies, text in zip(*(batch.column(c).to_pylist() for c in ("ahead", "key", "copies")), batch.column("text"), strict=True):
            if ahead:
                after = text.as_py() if after is None else after
                continue
            t = text.as_py()
            if chars > BLOCK_CHARS:
                yield pa.RecordBatch.from_pydict(_rows(held, t), schema=_ARROW)
                held, chars = [], 0
            held.append((key if key != NO_ID else None, t, copies))
            chars += len(t)
    if held:
        yield pa.RecordBatch.from_pydict(_rows(held, after), schema=_ARROW)


def _folded(docs: DataFrame) -> DataFrame:
    """docs (key, h, text) with equal rows folded: one row each, and copies."""
    one = F.lit(1).cast("long")
    ident = ["key", "h", F.xxhash64(F.lit(1), "text").alias("h2")]
    many = stash(docs.select(*ident).groupBy("key", "h", "h2").agg(F.count("*").alias("copies")).where("copies > 1"))
    if many.isEmpty():
        return docs.withColumn("copies", one)
    marked = docs.select(*ident, "text")
    few = small(many, BESIDE_TEXTS)
    folded = marked.join(few, ["key", "h", "h2"]).dropDuplicates(["key", "h", "h2"])
    return marked.join(few, ["key", "h", "h2"], "left_anti").withColumn("copies", one).unionByName(folded).drop("h2")


def fingerprint_with_neighbours(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to each other and to the next document's.

    Documents are dealt by ranges of (doc_id, hash of the text), so that a common
    doc_id is split; each range also gets the first document of the one after it (the last range: of the first).
    """
    spark = documents.sparkSession
    tx.small_batches(spark)
    docs = _folded(documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text")))
    n = width(spark)
    keys = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("h"))
    share = min(1.0, n * BORDER_ROWS / max(documents.count(), 1))
    drawn = keys.where(F.pmod(F.xxhash64(F.lit(7), "key", "h"), F.lit(1_000_000)) < share * 1e6).distinct()
    drawn = np.array(sorted((r.key, r.h) for r in drawn.collect()), np.int64).reshape(-1, 2)  # about BORDER_ROWS for each range
    cut_keys, cut_hashes = np.unique(drawn[[len(drawn) * i // n for i in range(1, n)]], axis=0).T if len(drawn) else np.zeros((2, 0), np.int64)

    @arrow_udf("int")
    def range_of(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        k, h = (x.to_numpy(zero_copy_only=False) for x in (keys, hashes))
        left, right = np.searchsorted(cut_keys, k, "left"), np.searchsorted(cut_keys, k, "right")
        out = right.copy()
        for lo in np.unique(left[left < right]):
            mine = (left == lo) & (left < right)
            hi = right[mine][0]
            out[mine] = lo + np.searchsorted(cut_hashes[lo:hi], h[mine], "right")
        return pa.array(out.astype(np.int32))

    part = range_of("key", "h").alias("part")
    firsts = keys.select(part, F.struct("key", "h").alias("at")).groupBy("part").agg(F.min("at").alias("at")).orderBy("part").collect()  # a row for each range
    listed = spark.createDataFrame([(r.at.key, r.at.h, firsts[i - 1].part) for i, r in enumerate(firsts)], "key long, h long, part int")
    looked = docs.join(F.broadcast(listed), ["key", "h"]).select("part", F.lit(True).alias("ahead"), "key", "h", "copies", "text")
    real = docs.select(part, F.lit(False).alias("ahead"), "key", "h", "copies", "text")
    dealt = real.unionByName(looked).repartitionById(len(cut_keys) + 1, F.col("part")).sortWithinPartitions("ahead", "key", "h", "text")
    found = dealt.select("ahead", "key", "copies", "text").mapInArrow(_run, _SCHEMA)
    chunk = F.explode(F.expr(f"if(copies = 1, array(1L), transform(sequence(0L, (copies - 1) div {SPREAD_ROWS}), i -> least(copies - i * {SPREAD_ROWS}, {SPREAD_ROWS}L)))"))
    return found.withColumn("copies", chunk).withColumn("copies", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).drop("copies")


def likeness_of(one: Column, two: Column) -> Column:
    @arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([likeness(a, b) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return run(one, two)


def near_classes(documents: DataFrame, least: float = NEAR) -> DataFrame:
    """Classes of near texts: print_id (xxhash64 of a fingerprint), representative (least doc_id of the class), near_representative (likeness to its fingerprint).

    Only fingerprints of several rows or in a class of several are listed.
    """
    tx.small_batches(documents.sparkSession)

    @arrow_udf("string")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts.fill_null("").to_pylist()), pa.string())

    @arrow_udf("array<long>")
    def bands(found: pa.Array) -> pa.Array:
        return pa.array(bands_of(found.to_pylist()), pa.list_(pa.int64()))

    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), prints("text").alias("text"))
    own = stash(keyed.select(F.xxhash64("text").alias("id"), "key", "text"))
    ids = stash(own.groupBy("id").agg(F.min("key").alias("rep"), F.count("*").alias("n")))

    def prints_of(wanted: DataFrame) -> DataFrame:
        return own.select("id", "text").join(small(stash(wanted.distinct()), BESIDE_TEXTS), "id", "left_semi").dropDuplicates(["id"])

    roots = stash(classes(own.select("id", bands("text").alias("bands")), prints_of, Likeness(least, 0, lambda p: p, lambda a, b, t: likeness(a, b) >= t), by_bucket=True))
    linked = stash(ids.join(roots, "id"))
    heads = linked.groupBy("root").agg(F.min(F.struct("rep", "id")).alias("head"))
    both = linked.join(heads, "root").select("id", "head")
    texts = stash(prints_of(both.select("id")))
    near = both.join(texts, "id").join(texts.select(F.col("id").alias("head_id"), F.col("text").alias("head_text")), F.col("head.id") == F.col("head_id"))
    near = near.select(F.col("id").alias("print_id"), F.col("head.rep").alias("representative"), likeness_of(F.col("text"), F.col("head_text")).alias("near_representative"))
    copies = ids.where("n > 1").join(roots, "id", "left_anti").select(F.col("id").alias("print_id"), F.col("rep").alias("representative"), F.lit(1.0).alias("near_representative"))
    return near.unionByName(copies)


def fingerprints_and_classes(documents: DataFrame, least: float = NEAR) -> DataFrame:
    """fingerprint_with_neighbours, with representative (the least doc_id of the near texts' class) and near_representative."""
    found = small(stash(near_classes(documents, least)), BESIDE_TEXTS)
    out = fingerprint_with_neighbours(documents).withColumn("print_id", F.xxhash64("fingerprint")).join(found, "print_id", "left").drop("print_id")
    alone = F.col("representative").isNull()
    return out.withColumns({"near_representative": F.coalesce("near_representative", F.lit(1.0)),
                            "representative": F.when(alone, F.col("doc_id")).when(F.col("representative") != NO_ID, F.col("representative"))})
