"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are the sources' token shares raised to an exponent and normalised.
The exponent is found by bisection (many points per round, each round one
aggregate over the table of sources) so that the weights meet a target
entropy, a limit on how often any source is repeated, or both.

A source's share of the token budget is then realised as epochs: in each
epoch its documents are dealt to blocks of about ``block_tokens`` and the
blocks are permuted by a hash. Whole epochs take every document; the last one
takes documents in permuted order until the budget is met. Where to cut is
found by radix passes over sums of tokens, so that no source, however large,
is sorted in one task; the text is read twice and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.shared import bounded, stage

BLOCK_TOKENS = 1_000_000
MAX_REPEATS = 2.0
POINTS = 63                     # points of one bisection round (6 halvings)
ROUNDS = 5
MAX_EXPONENT = 2.0 ** 20
DIGITS = (13, 13, 12, 12, 12)   # bits of the radix passes over the 62-bit order key


def word_count(text: Column) -> Column:
    """White-space-separated words; 0 for null or empty."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\r\x0b\x0c", "     "))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " +"))).cast("long")


def _power(exponent: Column, top: float) -> Column:
    """Share to the exponent, relative to the largest share (its logarithm is ``top``), so that it never underflows to 0 for all."""
    return F.exp(exponent * (F.log("share") - F.lit(top)))


def _at(sources: DataFrame, exponents: list[float], budget: float | None, top: float) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy of the weights, largest number of repeats), in one aggregate."""
    points = sources.select("share", "tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = _power(F.col("a"), top)
    sums = points.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * (F.log("share") - top)).alias("s"),
                                   F.max(power / F.col("tokens")).alias("most"),
                                   F.min(power / F.col("tokens")).alias("least"))
    out = {}
    for r in sums.collect():
        repeats = (r["most"] / r["least"] if r["least"] else math.inf) if budget is None else r["most"] / r["z"] * budget
        out[r["a"]] = (math.log(r["z"]) - r["a"] * r["s"] / r["z"], repeats)
    return out


def _bisect(sources: DataFrame, budget: float | None, top: float, enough, beyond: bool = False) -> float:
    """Smallest exponent with ``enough(entropy, repeats)``, which is false below some exponent and true above it.

    Looked for in [0, 1]; 1 if it holds nowhere there. With ``beyond`` the
    range then doubles until it holds; a ValueError if it does not up to
    ``MAX_EXPONENT``.
    """
    lo, hi = 0.0, 1.0
    if enough(*_at(sources, [0.0], budget, top)[0.0]):
        return 0.0
    while beyond and not enough(*_at(sources, [hi], budget, top)[hi]):
        lo, hi = hi, 2 * hi
        if hi > MAX_EXPONENT:
            raise ValueError("the target is out of reach of any exponent")
    for _ in range(ROUNDS):
        at = [lo + (hi - lo) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
        found = _at(sources, at, budget, top)
        passed = [a for a in at if enough(*found[a])]
        hi = min(passed, default=hi)
        lo = max((a for a in at if a < hi), default=lo)
    return hi


def choose_exponent(sources: DataFrame, budget: float | None, target_entropy: float | None,
                    max_repeats: float | None) -> float:
    """The flattest exponent that keeps both targets: entropy no more, repeats no more.

    A ValueError if an entropy below that of the natural shares is out of
    reach, or can be had only by repeats beyond the limit.
    """
    top = sources.agg(F.max(F.log("share"))).first()[0]
    found = [0.0]
    fits = lambda r: max_repeats is None or r <= max_repeats * (1 + 1e-9)
    if target_entropy is not None:
        found.append(_bisect(sources, budget, top, lambda h, _: h <= target_entropy, beyond=True))
    if max_repeats is not None:
        found.append(_bisect(sources, budget, top, lambda _, r: fits(r)))
    if max(found) > 1 and not fits(_at(sources, [max(found)], budget, top)[max(found)][1]):
        raise ValueError("no exponent keeps both the entropy and the limit on repeats")
    return max(found)


def _order_key(seed: int, epoch: Column, source: Column, doc: Column, blocks: Column) -> Column:
    """62 bits: the block's place in the epoch's permutation, then the document's in its block."""
    block = F.pmod(F.xxhash64(F.lit(seed), source, doc), blocks)
    high = F.pmod(F.xxhash64(F.lit(seed), epoch, source, block), F.lit(1 << 31))
    low = F.pmod(F.xxhash64(F.lit(seed + 1), epoch, source, doc), F.lit(1 << 31))
    return F.shiftleft(high, 31).bitwiseOR(low)


def _cuts(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut): smallest key at which a source's tokens, in key order, reach ``want``.

    Radix passes: sum the tokens by the next bits of the key, find the digit
    in which the running sum reaches what is wanted, keep its rows. A pass
    shuffles at most 2^13 sums per source and map task.
    """
    state = wanted.select("source", "want", F.lit(0).cast("long").alias("prefix"))
    shift = sum(DIGITS)
    for bits in DIGITS:
        state = stage(state, "mix-state")
        side = bounded(state, state.count(), 128)
        shift -= bits
        inside = keys.join(side, "source").filter(
            F.shiftright("key", shift + bits) == F.col("prefix")).select(
            "source", "want", F.shiftright("key", shift).alias("digit"), "tokens")
        sums = inside.groupBy("source", "digit").agg(F.sum("tokens").alias("tokens"), F.max("want").alias("want"))
        order = Window.partitionBy("source").orderBy("digit")
        run = sums.withColumn("upto", F.sum("tokens").over(order)).filter("upto >= want")
        state = run.groupBy("source").agg(F.min(F.struct("digit", "upto", "tokens", "want")).alias("x")).select(
            "source", (F.col("x.want") - F.col("x.upto") + F.col("x.tokens")).alias("want"),
            F.col("x.digit").alias("prefix"))
    return state.select("source", F.col("prefix").alias("cut"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS,
                budget_tokens: float | None = None, block_tokens: int = BLOCK_TOKENS,
                seed: int = 17) -> DataFrame:
    """``row`` (all columns of docs) and ``mix`` (epoch, n_tokens, order_key, weight), a row per copy taken.

    ``budget_tokens`` None sets the budget so that every document is taken at
    least once: the most down-weighted source gets one epoch, the others
    more, up to ``max_repeats``. A target entropy below that of the natural
    shares takes an exponent above 1. With a budget, a source whose part is less
    than its size is cut. If no exponent keeps the limit, the natural shares
    (exponent 1) are used and the budget is lowered to the limit.

    A null source is a source of its own. A document without words takes no
    budget: it comes in every whole epoch, and in the last one by its place.
    Repeated rows share their place and stay together. Sources without any
    word are taken once, whole. An empty table gives an empty result.
    """
    keyed = docs.select(F.struct("*").alias("row")).select(
        "row", F.concat(F.lit("s"), F.col(f"row.`{source_col}`").cast("string")).alias("s"),
        F.xxhash64(F.col(f"row.`{id_col}`")).alias("doc"), word_count(F.col(f"row.`{text_col}`")).alias("tokens"))
    keyed = keyed.withColumn("source", F.coalesce("s", F.lit("null"))).drop("s")
    numbers = stage(keyed.select("source", "doc", "tokens"), "mix-numbers")
    totals = stage(numbers.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    some = totals.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    n = totals.count()

    if total:
        budget = budget_tokens
        if budget is not None and max_repeats is not None:
            budget = min(budget, max_repeats * total)
        exponent = choose_exponent(some, budget, target_entropy, max_repeats)
        power = _power(F.lit(exponent), some.agg(F.max(F.log("share"))).first()[0])
        z, least = some.agg(F.sum(power), F.min(power / F.col("tokens"))).first()
        if budget is None and not least:
            raise ValueError("the weights are too far apart to take every document once")
        budget = z / least if budget is None else budget
        plan = some.select("source", "tokens", (power / z).alias("weight")).withColumn(
            "repeats", F.col("weight") * budget / F.col("tokens"))
    else:
        plan = totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats")).limit(0)
    # Whole epochs, what is wanted of the last, and the blocks; a rounding error is not an epoch.
    plan = totals.select("source").join(plan, "source", "left").select(
        "source", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.floor(F.coalesce("repeats", F.lit(1.0)) + 1e-6).cast("int").alias("whole"),
        F.coalesce("repeats", F.lit(1.0)).alias("repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.ceil(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(1)) / F.lit(block_tokens)).alias("blocks"))
    plan = stage(plan.withColumn("want", F.greatest(F.col("repeats") - F.col("whole"), F.lit(0.0)) * F.col("tokens")),
                 "mix-plan")
    side = bounded(plan.drop("tokens", "repeats"), n, 160)
    last = (numbers.join(side, "source").filter("want >= 1")
            .select("source", _order_key(seed, F.col("whole"), F.col("source"), F.col("doc"), F.col("blocks"))
                    .alias("key"), "tokens"))
    cuts = stage(_cuts(last, plan.filter("want >= 1")), "mix-cuts")
    full = stage(plan.join(bounded(cuts, n, 64), "source", "left"), "mix-final").drop("want", "tokens", "repeats")

    placed = keyed.join(bounded(full, n, 160), "source")
    epochs = F.sequence(F.lit(0), F.col("whole"))
    copies = placed.select("row", "source", "doc", "tokens", "weight", "whole", "blocks", "cut",
                           F.explode(epochs).alias("epoch"))
    key = _order_key(seed, F.col("epoch"), F.col("source"), F.col("doc"), F.col("blocks"))
    return (copies.withColumn("key", key).filter("epoch < whole or key <= cut")
            .select("row", F.struct("epoch", F.col("tokens").alias("n_tokens"), F.col("key").alias("order_key"),
                                    "weight").alias("mix")))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("row.doc_id", "row.source", "mix.epoch", "mix.n_tokens", "mix.order_key")
