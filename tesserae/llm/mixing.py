"""Temperature mixing of sources, in DataFrame functions only.

Shares of tokens by source are raised to an exponent t in [0, 1] and normalised; t = 1 keeps the
natural mix and t = 0 makes all sources equal. The exponent is the largest one that meets a target
(a least entropy, or a limit on how often a source repeats), found by repeated subdivision of [0, 1].
The weights become token budgets, and each budget is realised over blocks: a source's documents are
dealt into blocks by a hash, every epoch has its own permutation of the blocks and of the documents
in a block, and documents are taken in that order until the budget is spent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tesserae.llm._shared import Scratch, fresh

#: The interval of the exponent is cut into so many parts in each round: 6 rounds of 5 bisections.
PARTS, ROUNDS = 32, 6
#: Documents of a block, on average; the only window over documents is within one block.
BLOCK_ROWS = 2048


def tokens(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D], and one for the end of the text; null counts as empty."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long") + 1


def solve_exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None, epochs: float | None = None) -> float:
    """The largest exponent in [0, 1] whose weights have at least ``entropy`` of the greatest possible, and
    the least one under which no source repeats more than ``repeats`` times, whichever is asked for.

    ``sources`` has (share). ``epochs`` is the budget in epochs of the whole table; without it the budget is
    the least that uses every source once. A limit on repeats that no exponent meets gives the natural mix.
    Each round is one small aggregate over sources; nothing is gathered but one number.
    """
    lo, hi = 0.0, 1.0
    p, t = F.col("share"), F.col("t")
    for _ in range(ROUNDS):
        step = (hi - lo) / PARTS
        grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS)), lambda i: F.lit(lo) + i * F.lit(step)))
        power = F.exp(t * F.log(p))
        by = sources.select("share", grid.alias("t")).groupBy("t").agg(
            F.sum(power).alias("z"), F.sum(power * F.log(p)).alias("s"), F.max(power / p).alias("most"), F.min(power / p).alias("least"), F.count("*").alias("k")
        )
        # entropy of the weights grows, and the longest repetition shrinks, as t goes to 0 and 1
        if entropy is not None:
            met = (F.log("z") - t * F.col("s") / F.col("z")) >= F.lit(entropy) * F.log("k") - F.lit(1e-12)
            best = by.where(met).agg(F.max("t")).first()[0]
            lo, hi = (best, min(hi, best + step)) if best is not None else (lo, lo)
        else:
            times = F.col("most") / F.col("least") if epochs is None else F.col("most") * F.lit(epochs) / F.col("z")
            met = times <= F.lit(float(repeats)) + F.lit(1e-12)
            best = by.where(met).agg(F.min("t")).first()[0]
            lo, hi = (max(lo, best - step), best) if best is not None else (hi, hi)
    return lo if entropy is not None else hi


def plan(docs: DataFrame, scratch: Scratch, entropy: float | None, repeats: float | None, budget: float | None, source_col: str, text_col: str, id_col: str, seed: int) -> DataFrame:
    """One row per copy of a document in the mix; see :func:`mix`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens(F.col(text_col)).alias("n"))
    rows = scratch.write(rows, "rows")
    totals = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
    every = rows.agg(F.sum("n")).first()[0]
    if not every:
        return None
    sources = scratch.write(totals.withColumn("share", F.col("n_tokens") / F.lit(float(every))), "sources")
    t = solve_exponent(sources, entropy, repeats, None if budget is None else budget / every)
    w = F.exp(F.lit(t) * F.log("share"))
    z = sources.agg(F.sum(w)).first()[0]
    if budget is None:  # the least total that uses every source once
        budget = sources.agg(F.max(F.col("n_tokens") * F.lit(z) / w)).first()[0]
    sources = sources.withColumn("weight", w / F.lit(z)).withColumn("budget", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))
    sources = sources.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.col("n_docs") / BLOCK_ROWS).cast("long"))
    # every source has an epoch for each time its tokens fit in the budget, and one more for the rest
    sources = scratch.write(sources.withColumn("epochs", F.ceil(F.col("budget") / F.col("n_tokens")).cast("int")), "budgets")
    dealt = rows.join(F.broadcast(sources.select("source", "blocks")) if sources.count() <= 10_000 else sources.select("source", "blocks"), rows.source.eqNullSafe(sources.source)).select(rows.doc_id, rows.source, "n", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "blocks").alias("block"))
    dealt = scratch.write(dealt, "dealt")
    # first within the source: where each block of each epoch begins. An epoch takes as long as the source;
    # in it blocks are in order of a hash, whose ranges are added up before the blocks of a range
    per_block = dealt.groupBy("source", "block").agg(F.sum("n").alias("size"))
    epochs = F.explode(F.expr("if(epochs > 0, sequence(0, epochs - 1), array())"))
    b = per_block.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "block", "size", "budget", "n_tokens", "blocks", epochs.alias("epoch"))
    place = F.xxhash64(F.lit(seed), "epoch", "block")
    high = F.shiftright(place, 32) + F.lit(1 << 31)  # in [0, 2^32)
    b = b.withColumns({"place": place, "part": F.floor(high * F.ceil(F.sqrt("blocks")) / F.lit(float(1 << 32)))})
    parts = b.groupBy("source", "epoch", "part").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("source", "epoch").orderBy("part")) - F.col("total")
    parts = parts.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("part").alias("p"), before.alias("before"))
    b = b.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("part") == F.col("p")))
    within = F.sum("size").over(Window.partitionBy("source", "epoch", "part").orderBy("place", "block")) - F.col("size")
    b = b.withColumn("begin", F.col("epoch") * F.col("n_tokens") + F.col("before") + within).where("begin < budget").select("source", "block", "epoch", "begin", "budget")
    b = scratch.write(b, "blocks")
    # then within the block: which documents begin before the budget is spent
    each = dealt.alias("d").join(b.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block"))).select("d.doc_id", "d.source", "d.n", "d.block", "b.epoch", "b.begin", "b.budget")
    inner = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "doc_id"), "doc_id", "n")
    each = each.withColumn("position", F.col("begin") + F.sum("n").over(inner) - F.col("n"))
    return each.where("position < budget").select("doc_id", "source", "epoch", "position", F.col("n").alias("n_tokens"))


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """(doc_id, source, epoch int, position long, n_tokens long): one row per copy of a document in the mix.

    Give ``entropy`` (a share of the greatest entropy) or ``repeats`` (a limit on epochs of any source).
    ``budget`` is the mix's number of tokens; by default the least with which every source is used
    once, so no document is lost. A source's documents are taken from ``position`` 0 until its budget
    is spent, so it is exceeded by less than one document. A null source is a source of its own; a
    null text counts as empty; repeated rows are documents of their own. An empty table gives an
    empty result. Other columns are ignored.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give either entropy or repeats")
    out = plan(docs, Scratch(docs.sparkSession, "mixing"), entropy, repeats, budget, source_col, text_col, id_col, seed)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, source string, epoch int, position long, n_tokens long")
    return out


def mixed_rows(docs: DataFrame, repeats: float, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with their columns, whatever their names.

    Rows that repeat an id, or have none, share its copies, rounded up, so that each of them stays. An
    empty table gives an empty result.
    """
    key = F.col(id_col).cast("long")
    times = mix(docs, repeats=repeats, id_col=id_col, **more).groupBy("doc_id").agg(F.count("*").alias("copies"))
    own = docs.groupBy(key.alias("own")).agg(F.count("*").alias("rows"))
    a, b = (fresh(n, docs.columns) for n in ("id", "times"))
    times = times.join(own, F.col("doc_id").eqNullSafe(F.col("own"))).select(F.col("doc_id").alias(a), F.ceil(F.col("copies") / F.col("rows")).alias(b))
    joined = docs.join(times, key.eqNullSafe(F.col(a)))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(b))).alias(b)).drop(b)
