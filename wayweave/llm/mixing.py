"""Mixing sources to target weights: temperature, bisected exponent, block permutations. SQL expressions only.

A source of token share p gets the weight p^t / sum p^t. The exponent t in
[0, 1] is bisected: the largest one whose weights have at least `entropy` of
the greatest possible entropy, but no less than the least one at which no
source is read more than `repeats` times (1 if even that is too much). A
source's quota is its weight times the budget (by default all tokens there are).

Realisation: a source's documents fall into blocks of about BLOCK_ROWS by a keyed
hash, and the blocks into a keyed order. Whole passes over the source come
first; of the last one the blocks that fit are taken, and from the block at the
edge the documents that fit, in keyed order. No task needs more of a source
than the sums of its blocks and one block, and a source misses its quota by
less than one document.

Tokens are runs of characters other than space, tab, line feed and carriage
return. A null source is a source of its own. Documents without tokens have
no weight and 0 copies. Rows of one doc_id and source go together. An empty
table gives no rows. Extra columns stay (in `mix`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import BESIDE_TEXTS, small, stash

ENTROPY, REPEATS = 0.95, 4.0
BLOCK_ROWS = 1000
SEED = "mix-1"
STEPS = 60
_SPACE = " \t\n\r"


def tokens(text: str = "text") -> Column:
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, "[ \t\n\r]+"))).cast("long")


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def row_key() -> Column:
    """Orders documents at random, the same way every time."""
    return F.md5(F.concat_ws("|", F.lit(SEED), source_key(), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def _block(key: str, n: str) -> str:
    return f"cast(conv(substr({key}, 1, 8), 16, 10) as bigint) % {n}"


def _sums(t: str) -> str:
    """Struct of sum p^t and sum p^t ln p over the array `sizes`."""
    return (f"aggregate(sizes, named_struct('z', 0D, 'l', 0D), (a, x) -> named_struct('z', a.z + pow(x / total, {t}),"
            f" 'l', a.l + pow(x / total, {t}) * ln(x / total)))")


def _bisect(holds: str) -> str:
    """(lo, hi) around the point of [0, 1] up to which `holds` (of the sums s at m)."""
    probe = f"transform(array((b.lo + b.hi) / 2), m -> transform(array({_sums('m')}), s -> {holds})[0])[0]"
    step = f"if({probe}, named_struct('lo', (b.lo + b.hi) / 2, 'hi', b.hi), named_struct('lo', b.lo, 'hi', (b.lo + b.hi) / 2))"
    return f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (b, i) -> {step})"


def exponent(stats: DataFrame, budget: float | None, entropy: float, repeats: float) -> DataFrame:
    """One row: t, z (sum p^t), total, budget; from rows (src, size, n) of sources that have tokens."""
    row = stats.agg(F.sort_array(F.collect_list(F.col("size").cast("double"))).alias("sizes"), F.sum("size").cast("double").alias("total"))
    row = row.withColumn("budget", F.lit(budget).cast("double") if budget is not None else F.col("total"))
    spread = _bisect(f"ln(s.z) - m * s.l / s.z >= {entropy!r} * ln(size(sizes))")
    often = _bisect(f"budget / total * pow(sizes[0] / total, m - 1) / s.z > {repeats!r}")
    both = row.where("total > 0").selectExpr("sizes", "total", "budget", f"greatest({spread}.lo, {often}.hi) as raw")
    one = both.selectExpr("sizes", "total", "budget", "if(raw > 0.5 and 1 - raw < 1e-9, 1D, if(raw < 1e-9, 0D, raw)) as t")
    return one.selectExpr("t", f"{_sums('t')}.z as z", "total", "budget")


def decide(sized: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows (src, k, tokens): per source (weight, passes, n_blocks), blocks of the last pass, documents of its edge block."""
    stats = stash(sized.groupBy("src").agg(F.sum("tokens").alias("size"), F.count("*").alias("n")).where("size > 0"))
    one = exponent(stats, budget, entropy, repeats).first() or {"t": 1.0, "z": 1.0, "total": 1.0, "budget": 0.0}
    t, z, total, aim = (F.lit(float(one[c])) for c in ("t", "z", "total", "budget"))
    sources = stash(
        stats.select("src", "size", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long").alias("n_blocks"),
                     (F.pow(F.col("size") / total, t) / z).alias("weight"))
        .select("src", "n_blocks", "weight", "size", F.floor(F.col("weight") * aim).cast("long").alias("quota"))
        .selectExpr("src", "n_blocks", "weight", "quota", "quota div size as passes", "quota % size as rest")
    )
    placed = sized.join(small(sources), "src").withColumn("block", F.expr(_block("k", "n_blocks")))
    order = Window.partitionBy("src").orderBy(F.md5(F.concat_ws("|", F.lit(SEED), "src", F.col("block").cast("string")).cast("binary")), "block")
    blocks = stash(
        placed.groupBy("src", "block", "rest").agg(F.sum("tokens").alias("held"))
        .withColumn("upto", F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where("upto - held < rest")
        .selectExpr("src", "block", "upto <= rest as whole", "rest - (upto - held) as room")
    )
    edge = small(stash(blocks.where("not whole").select("src", "block", "room")))
    running = F.sum("tokens").over(Window.partitionBy("src").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = stash(
        placed.select("src", "block", "k", "tokens").join(edge, ["src", "block"]).withColumn("run", running)
        .where("run <= room").select("src", "k").distinct()
    )
    return sources, blocks.where("whole").select("src", "block"), chosen


def copies(rows: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """rows (with columns src, k) with __weight and __copies; each lookup is broadcast up to a counted size."""
    sources, whole, chosen = plan
    a = sources.selectExpr("src as __a", "n_blocks as __n", "weight as __weight", "passes as __passes")
    b = whole.selectExpr("src as __b", "block as __bb", "1 as __whole")
    c = chosen.selectExpr("src as __c", "k as __ck", "1 as __chosen")
    out = rows.join(small(a, BESIDE_TEXTS), F.col("src") == F.col("__a"), "left").withColumn("__block", F.expr(_block("k", "__n")))
    out = out.join(small(b, BESIDE_TEXTS), (F.col("src") == F.col("__b")) & (F.col("__block") == F.col("__bb")), "left")
    out = out.join(small(c, BESIDE_TEXTS), (F.col("src") == F.col("__c")) & (F.col("k") == F.col("__ck")), "left")
    total = F.expr("coalesce(__passes, 0L) + coalesce(__whole, 0) + coalesce(__chosen, 0)")
    return out.withColumn("__copies", total)


def _sized(documents: DataFrame) -> DataFrame:
    return stash(documents.select("doc_id", "source", source_key().alias("src"), row_key().alias("k"), tokens().alias("tokens")))


def mixture(documents: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """One row per document: doc_id, source, tokens, weight (of its source), copies (in the mixture)."""
    sized = _sized(documents)
    out = copies(sized, decide(sized, budget, entropy, repeats))
    return out.selectExpr("doc_id", "source", "tokens", "coalesce(__weight, 0D) as weight", "if(tokens = 0, 0L, __copies) as copies")


def mix(documents: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """The mixture itself: each document (all its columns) as often as it is read."""
    plan = decide(_sized(documents), budget, entropy, repeats)
    keyed = documents.withColumns({"src": source_key(), "k": row_key()}) if not {"src", "k"} & set(documents.columns) else None
    if keyed is None:  # a clash of names: keep the originals aside
        held = documents.select(F.struct("*").alias("__doc"), "doc_id", "source", "text")
        keyed = held.withColumns({"src": source_key(), "k": row_key()})
    out = copies(keyed, plan).where((F.col("__copies") > 0) & (tokens() > 0))
    out = out.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.select("__doc.*") if "__doc" in out.columns else out.select(*documents.columns)
