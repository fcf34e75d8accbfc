"""Mixing sources to target weights.

A source's weight is its token share to the power of alpha, normalised: alpha 1 keeps the shares, 0 makes all sources
equal. alpha is bisected to the largest value that meets the target: an entropy of the weights, as a part of the largest
possible one, or a limit on how often a source repeats. The budget of tokens times the weight is a source's quota, which
is realised as block permutations: the documents of a source fall by hash into blocks of about block_tokens, each epoch
is a permutation of the blocks, and whole blocks are taken until the quota is reached; only the block that meets it is
cut, at a document.

Everything here is DataFrame operations. Documents are read twice, for id, source and the number of words; no text is
shuffled. The largest group that one task sees is a block; prefix sums over blocks go in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import write_table

#: Halvings of alpha's interval: the result is a multiple of 2**-BISECTIONS.
BISECTIONS = 20

#: Halvings that one pass over the sources decides: it evaluates all points that these can reach.
HALVINGS_A_PASS = 5

#: Tokens of a block, as a target.
BLOCK_TOKENS = 50_000

#: Documents of a block, about, where they have fewer tokens than a block.
BLOCK_DOCUMENTS = 50_000


def token_count(text: Column) -> Column:
    """Words between ASCII spaces; 0 for null."""
    return F.coalesce(F.size(F.split(text, "[^ \\t\\n\\x0B\\f\\r]+", -1)).cast("long") - 1, F.lit(0).cast("long"))


def _hex(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))


def _meets(sources: DataFrame, alphas: list[float], target: str, value: float, total: int, cover: bool, budget: int | None) -> dict:
    """alpha: whether the weights at it meet the target. One pass; one row per alpha comes back."""
    points = sources.select("tokens", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    share = F.col("tokens") / F.lit(float(total))
    powers = points.select("alpha", "tokens", F.pow(share, F.col("alpha")).alias("p"))
    # of weights p / z: entropy = ln z - sum(p ln p) / z; repetition of a source = (p / z) * budget / tokens
    sums = powers.groupBy("alpha").agg(
        F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("e"), F.count("*").alias("n"),
        F.max(F.col("p") / F.col("tokens")).alias("most"), F.min(F.col("p") / F.col("tokens")).alias("least"),
    )
    if target == "entropy":
        met = F.log("z") - F.col("e") / F.col("z") >= F.lit(value) * F.log("n") - 1e-12
    elif cover:
        met = F.col("most") <= F.lit(value) * F.col("least") * (1 + 1e-12)
    else:
        met = F.col("most") * F.lit(float(budget)) / F.col("z") <= value * (1 + 1e-12)
    return {r["alpha"]: r["met"] for r in sums.select("alpha", met.alias("met")).collect()}


def bisect_alpha(sources: DataFrame, target: str, value: float, budget: int | None = None) -> float:
    """Bisect alpha over sources (source, tokens > 0): the multiple of 2**-BISECTIONS next to where the target turns.

    target "entropy": the largest alpha whose weights have at least value (0 to 1) of the largest entropy.
    target "repetition": the smallest alpha at which no source is read more than value times; without a budget, at the
    budget that reads each source at least once. If alpha 0 doesn't meet an entropy, or alpha 1 a repetition limit, that
    end is the result. Tables without tokens have alpha 1.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    # lo meets an entropy target, hi a repetition limit; in steps of 2**-BISECTIONS
    lo, hi, unit = 0, 1 << BISECTIONS, 1 << BISECTIONS
    seen: dict[float, bool] = {}
    wants_low = target == "entropy"
    if _meets(sources, [1.0 if wants_low else 0.0], target, value, total, budget is None, budget).popitem()[1]:
        return 1.0 if wants_low else 0.0
    while hi - lo > 1:
        points, ends = set(), [(lo, hi)]
        for _ in range(HALVINGS_A_PASS):
            middles = [(a, (a + b) // 2, b) for a, b in ends if b - a > 1]
            points |= {m for _, m, _ in middles}
            ends = [x for a, m, b in middles for x in ((a, m), (m, b))]
        seen = _meets(sources, [p / unit for p in sorted(points)], target, value, total, budget is None, budget)
        while hi - lo > 1 and (middle := (lo + hi) // 2) in points:
            if seen[middle / unit] == wants_low:
                lo = middle
            else:
                hi = middle
    return (lo if wants_low else hi) / unit


def mixture(
    docs: DataFrame,
    target: str = "entropy",
    value: float = 0.98,
    budget: int | None = None,
    cover: bool = False,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """How often the mixture reads each document: one row per row of docs, also for those that it leaves out.

    Columns: the id, source, tokens, alpha, weight (of the source), copies (times that the document is read).
    target, value: see bisect_alpha. budget: tokens of the mixture; by default as many as docs have, or with cover the
    fewest that read each source at least once. A quota is met at the first document that reaches it, so a source exceeds
    its quota by less than a document. A null source is a source of its own, '' another. Documents without tokens (null, empty)
    go with their source's epochs and blocks; a source without any tokens has weight 0 and copies 0. Rows with a null id, and
    repeated rows, are documents as others; rows that repeat id, source and tokens share their fate. An empty table gives an empty result. Other columns are not read.
    """
    known = F.concat(F.lit("="), F.col(source_col))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(known, F.lit("null")).alias("_source"), token_count(F.col(text_col)).alias("_tokens")
    )
    rows = write_table(rows, "tokens")
    sources = rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("documents")).filter("tokens > 0")
    sources = write_table(sources.withColumnRenamed("_source", "source"), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    wanted = None if cover else budget or total
    alpha = bisect_alpha(sources, target, value, wanted)
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(alpha))
    sums = sources.agg(F.sum(power).alias("z"), F.min(power / F.col("tokens")).alias("least")).first()
    z, least = sums["z"] or 1.0, sums["least"] or 1.0
    tokens_wanted = z / least if cover else float(wanted or 0)
    weight = power / F.lit(z)
    quota = F.ceil(weight * F.lit(tokens_wanted) - 1e-6).cast("long") if cover else F.floor(weight * F.lit(tokens_wanted) + 1e-6).cast("long")
    plan = sources.select(
        F.col("source").alias("_source"), weight.alias("weight"), (quota / F.col("tokens")).cast("long").alias("_epochs"),
        (quota % F.col("tokens")).alias("_rest"), F.ceil(F.greatest(F.col("tokens") / F.lit(block_tokens), F.col("documents") / F.lit(BLOCK_DOCUMENTS))).cast("long").alias("_blocks"),
    )
    plan = write_table(plan, "mixture")

    # the last, partial epoch: blocks in the order of a keyed hash, up to the rest of the quota
    in_plan = rows.join(plan, "_source", "left")
    name = _hex(F.lit(seed), F.col("_source"), F.col("_id"))
    block = F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % F.col("_blocks")
    dealt = write_table(in_plan.withColumn("_block", block).withColumn("_name", name), "blocks")
    blocks = dealt.filter("_rest > 0").groupBy("_source", "_block", "_rest", "_blocks").agg(F.sum("_tokens").alias("_sum"))
    blocks = blocks.withColumn("_key", _hex(F.lit(seed), F.lit("block"), F.col("_source"), F.col("_block")))
    # prefix sums in two levels: about sqrt(blocks) strides of the hash range, then the blocks within a stride
    stride = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.ceil(F.sqrt("_blocks")) / F.lit(1 << 32)).cast("long")
    blocks = write_table(blocks.withColumn("_stride", stride), "blocks")
    before = Window.partitionBy("_source").orderBy("_stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = blocks.groupBy("_source", "_stride").agg(F.sum("_sum").alias("_all"))
    strides = strides.select("_source", "_stride", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("_source", "_stride").orderBy("_key", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(strides, ["_source", "_stride"])
    blocks = blocks.withColumn("_at", F.col("_from") + F.coalesce(F.sum("_sum").over(within), F.lit(0)))
    blocks = blocks.filter("_at < _rest").select("_source", "_block", "_at", (F.col("_at") + F.col("_sum") > F.col("_rest")).alias("_cut"))
    blocks = write_table(blocks, "taken")

    taken = dealt.join(blocks, ["_source", "_block"], "left")
    cut = taken.filter("_cut")
    order = Window.partitionBy("_source", "_block").orderBy("_name", "_id", "_tokens")
    before = F.col("_at") + F.sum("_tokens").over(order) - F.col("_tokens")
    cut = cut.withColumn("_extra", (before < F.col("_rest")).cast("long"))
    whole = taken.filter("_cut is null or not _cut").withColumn("_extra", F.col("_at").isNotNull().cast("long"))
    return whole.unionByName(cut).select(
        F.col("_id").alias(id_col),
        F.when(F.col("_source") != "null", F.substring("_source", 2, 1 << 30)).alias(source_col),
        F.col("_tokens").alias("tokens"),
        F.lit(alpha).alias("alpha"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        (F.coalesce("_epochs", F.lit(0)) + F.col("_extra")).alias("copies"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixture itself: docs with each row as often as mixture() says; columns as in docs.

    Rows of one id, null ids too, are all taken as often as the one of them that is taken most.
    """
    plan = mixture(docs, id_col=id_col, **options).groupBy(F.col(id_col).alias("_mixed")).agg(F.max("copies").alias("_copies"))
    out = docs.join(plan.filter("_copies > 0"), docs[id_col].eqNullSafe(plan["_mixed"]))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*[docs[c] for c in docs.columns])
