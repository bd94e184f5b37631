"""Benchmark decontamination by winnowing, in SQL expressions only.

Texts become words (A-Z lower-cased; runs of ASCII letters, digits and
everything beyond ASCII). Every k-gram of words is hashed; in every window of
w consecutive k-grams the least hash is kept. As k + w - 1 = 13, two texts that
share any 13 words in a row keep a common fingerprint from that window, so the
join of document and benchmark fingerprints misses no shared window. Each hit
names a diagonal (document position minus item position); it is extended along
the diagonal by comparing the words themselves, so hash collisions never count.

Items of fewer than 13 words are one window of their own length and take a
join on the hash of exactly that many words, extended in the same way.

Nulls and texts without words: no words, never hit. Repeated rows of one
doc_id are separate documents; repeated item rows count once per item_id. Items of
null item_id hit words, but are neither counted nor listed.
Null doc_ids are kept. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import BESIDE_TEXTS, small, stash

WINDOW = 13
K = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAKS = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"
KEY = ("coalesce(cast(doc_id as bigint), -9223372036854775808L) as d", "xxhash64(text, doc_id is null) as h")


def words_sql(col: str) -> str:
    return f"filter(split(translate({col}, '{UPPER}', '{UPPER.lower()}'), '{BREAKS}'), x -> x <> '')"


def _let(value: str, name: str, body: str) -> str:
    """Bind a value once: the optimizer copies columns into lambdas, but not lambda variables."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shifted(name: str, by: int, combine: str) -> str:
    return (f"zip_with(slice({name}, 1, greatest(size({name}) - {by}, 0)),"
            f" slice({name}, {by} + 1, greatest(size({name}) - {by}, 0)), (x, y) -> {combine})")


def _chain(base: str, steps: list[tuple[int, str]], last: str = "{}") -> str:
    body = last.format(f"v{len(steps)}")
    for i in reversed(range(len(steps))):
        body = _let(_shifted(f"v{i}", *steps[i]), f"v{i + 1}", body)
    return _let(base, "v0", body)


def _widen(n: int, combine: str) -> list[tuple[int, str]]:
    """Shifts that fold n neighbours into one by doubling (a final overlap is harmless for both folds)."""
    steps, have = [], 1
    while have < n:
        by = min(have, n - have)
        steps.append((by, combine))
        have += by
    return steps


def grams_sql(hashes: str, n: int) -> str:
    """Hashes of all n-grams, in order, from an array of word hashes; those of fewer than WINDOW words are told apart by length."""
    grams = _chain(hashes, _widen(n, "xxhash64(x, y)"))
    return f"transform({grams}, g -> xxhash64({n}, g))" if n != K else grams


def fingerprints_sql(hashes: str, k: int = K, window: int = WINDOW) -> str:
    """Winnowed fingerprints (distinct least hashes); empty below `window` words."""
    return _chain(hashes, _widen(k, "xxhash64(x, y)") + _widen(window - k + 1, "least(x, y)"), "array_distinct({})")


def _each(words: str, parts: list[str]) -> str:
    """One array of several (of the word hashes `hs`), with the words cut and hashed once."""
    return _let(f"transform({words}, x -> xxhash64(x))", "hs", parts[0] if len(parts) == 1 else f"flatten(array({', '.join(parts)}))")


def _placed(hashes: str) -> str:
    return f"transform({hashes}, (f, i) -> named_struct('pos', i, 'fp', f))"


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct item texts: item_key, words, n, item_ids (of all items with these words)."""
    return (
        benchmark.selectExpr("cast(item_id as string) as item_id", f"{words_sql('text')} as words")
        .where("size(words) > 0").groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
        .selectExpr("xxhash64(words) as item_key", "words", "size(words) as n", "item_ids")
    )


def find_hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit documents only: doc_key (two bigints d, h), n_hit, item_ids.

    d is doc_id (null: the least bigint), h a hash of the text and of
    doc_id being null; equal rows share a key and so a result.
    """
    items = stash(_item_windows(benchmark))
    short = sorted(r.n for r in items.where(f"n < {WINDOW}").select("n").distinct().collect())  # 12 values at most
    side = lambda df: small(df, BESIDE_TEXTS)
    words = words_sql("text")
    keyed = documents.selectExpr(*KEY, "text")

    # 1. documents with a fingerprint of an item, or with as many words as a short item has, and the same: one pass
    longer, shorter = items.where(f"n >= {WINDOW}"), items.where(f"n < {WINDOW}")
    anchors = longer.selectExpr("item_key", _each("words", [fingerprints_sql("hs")]) + " as fps", "inline(" + _each("words", [_placed(grams_sql("hs", K))]) + ")").where("array_contains(fps, fp)").select("item_key", "pos", "fp")
    for n in short:
        anchors = anchors.unionByName(shorter.where(f"n = {n}").selectExpr("item_key", "inline(" + _each("words", [_placed(grams_sql("hs", n))]) + ")"))
    anchors = stash(anchors.withColumnRenamed("pos", "ipos"))
    prints = _each(words, [fingerprints_sql("hs"), *(grams_sql("hs", n) for n in short)])
    found = keyed.selectExpr("d", "h", f"explode({prints}) as fp").join(side(anchors.select("fp").distinct()), "fp", "left_semi").select("d", "h")
    near = stash(found.distinct())
    near_words = stash(
        keyed.join(side(near), ["d", "h"], "left_semi").dropDuplicates(["d", "h"]).selectExpr("d", "h", f"{words} as dw")
    )

    # 2. diagonals on which a fingerprint of an item lies
    spots = _each("dw", [_placed(grams_sql("hs", K)), *(_placed(grams_sql("hs", n)) for n in short)])
    lines = near_words.selectExpr("d", "h", f"inline({spots})").join(side(anchors), "fp").selectExpr("d", "h", "item_key", "pos - ipos as line")
    lines = stash(lines.distinct())

    # 3. extension: runs of equal words on a diagonal, as long as a window
    segments = (
        lines.join(near_words, ["d", "h"]).join(side(items), "item_key")
        .selectExpr("d", "h", "item_key", "line", "n", "item_ids", "greatest(line, 0) as first",
                    "slice(dw, greatest(line, 0) + 1, n + least(line, 0)) as a", "slice(words, 1 - least(line, 0), n) as b")
        .selectExpr("d", "h", "item_key", "n", "item_ids", "first",
                    "transform(sequence(0, least(size(a), size(b)) - 1), j -> if(a[j] = b[j], 1, 0)) as same")
    )
    run = _chain("same", _widen(WINDOW, "x * y"))
    covered = segments.selectExpr(
        "d", "h", "item_key", "item_ids",
        f"""if(n >= {WINDOW},
               array_distinct(flatten(transform(filter(transform({run}, (x, j) -> if(x = 1, j, -1)), j -> j >= 0),
                                                j -> sequence(first + j, first + j + {WINDOW - 1})))),
               if(size(same) = n and array_min(same) = 1, sequence(first, first + n - 1), cast(array() as array<int>))) as at""",
    ).where("size(at) > 0")
    covered = stash(covered)
    n_hit = covered.selectExpr("d", "h", "explode(at) as p").distinct().groupBy("d", "h").agg(F.count("*").alias("n_hit"))
    ids = (covered.select("d", "h", "item_key", "item_ids").dropDuplicates(["d", "h", "item_key"])
           .selectExpr("d", "h", "explode(item_ids) as item_id").groupBy("d", "h")
           .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    return n_hit.join(ids, ["d", "h"], "left").withColumn("item_ids", F.expr("coalesce(item_ids, cast(array() as array<string>))"))


def decontamination_report(documents: DataFrame, benchmark: DataFrame, factor: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated.

    Contaminated: n_hit > 0 and factor * n_hit >= n_words.
    """
    hits = small(stash(find_hits(documents, benchmark)), BESIDE_TEXTS)
    return (
        documents.selectExpr("doc_id", *KEY, f"cast(coalesce(size({words_sql('text')}), 0) as bigint) as n_words")
        .withColumn("n_words", F.greatest("n_words", F.lit(0))).join(hits, ["d", "h"], "left")
        .selectExpr("doc_id", "n_words", "coalesce(n_hit, 0L) as n_hit", "cast(coalesce(size(item_ids), 0) as bigint) as n_items",
                    "coalesce(item_ids, cast(array() as array<string>)) as item_ids")
        .selectExpr("doc_id", "n_words", "n_hit", "greatest(n_items, 0L) as n_items", "item_ids",
                    f"n_hit > 0 and {factor} * n_hit >= n_words as contaminated")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, factor: int = 20) -> DataFrame:
    """The documents (all their columns) that are not contaminated."""
    hits = find_hits(documents, benchmark)
    words = documents.selectExpr(*KEY, "text")
    bad = stash(
        words.join(small(stash(hits.select("d", "h", "n_hit")), BESIDE_TEXTS), ["d", "h"])
        .where(f"{factor} * n_hit >= size({words_sql('text')})").selectExpr("d as __bad_d", "h as __bad_h").distinct()
    )
    d, h = (F.expr(x.rsplit(" as ", 1)[0]) for x in KEY)
    bad = small(bad, BESIDE_TEXTS)
    return documents.join(bad, (d == bad["__bad_d"]) & (h == bad["__bad_h"]), "left_anti")
