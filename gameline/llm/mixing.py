"""Temperature mixing of sources, realised as budgeted block permutations.

With token shares p of the sources and an exponent a, weights are p^a, normalised.  a = 1 keeps the
natural mixture, a = 0 gives all sources the same weight.  The exponent is bisected until

* the entropy of the weights is ``entropy`` times the largest possible one, ln(number of sources), or
* no source is repeated more than ``max_repeats`` times: weight * budget / tokens <= ``max_repeats``.

The entropy falls and the largest repetition falls as the exponent rises to 1, so each has one smallest
or largest exponent in [0, 1] that meets the target.  If both are given the larger exponent is taken.

A source's budget, weight * ``budget`` tokens, is drawn in whole passes and a rest.  In each pass the
documents of a source stand in blocks by a hash of seed, pass and document; the order of blocks, and of
documents in a block, is a permutation by hash.  Whole blocks are drawn while they fit in the rest of the
budget; in the one block where it ends, documents are drawn while it lasts: until the tokens before a
document reach the budget, so a budget is met and overshot by less than one document.  Only block totals
are ever ordered over a whole source, so a source with a third of all rows needs no large sort.

``draw`` works on ids and token counts alone and gives one row per drawn copy: id, source, ``mix_pass`` (0
for the first copy), ``mix_block`` (place of the block in its pass) and ``mix_key`` (double from 0 to about 1:
in its order every source, pass after pass, is spread evenly over the mixture).  ``mix`` joins the documents to it.

A null source is a source.  A null text has no tokens.  A document without tokens is drawn with every pass
that is drawn whole, else where it stands in its block; a source without any tokens is not drawn.  Rows with
equal id and source are drawn together.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import stored, table

ENTROPY = 0.97
MAX_REPEATS = 4.0
BLOCK_TOKENS = 300_000
STEPS = 60


def weights_at(tokens: Sequence[float], exponent: float) -> list[float]:
    """Normalised powers of the token shares; a source without tokens has weight 0."""
    total = math.fsum(tokens)
    powers = [math.pow(t / total, exponent) if t > 0 else 0.0 for t in tokens]
    norm = math.fsum(powers)
    return [p / norm for p in powers]


def entropy_of(weights: Sequence[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def bisect_exponent(tokens: Sequence[float], budget: float, entropy: float | None = ENTROPY,
                    max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent in [0, 1] that the targets ask for; 1 where even that cannot meet a repetition limit."""
    some = [t for t in tokens if t > 0]
    if len(some) < 2:
        return 1.0

    def least(meets) -> float:
        """Smallest exponent for which ``meets`` holds, given that it holds from some point on."""
        if meets(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if meets(mid) else (mid, high)
        return high

    wanted = []
    if entropy is not None:
        target = entropy * math.log(len(some))
        wanted.append(least(lambda a: entropy_of(weights_at(some, a)) <= target))
    if max_repeats is not None:
        wanted.append(least(lambda a: max(w * budget / t for w, t in zip(weights_at(some, a), some)) <= max_repeats))
    return max(wanted, default=1.0)


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r\f]+")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def plan_weights(sized: DataFrame, budget: float | None = None, entropy: float | None = ENTROPY,
                 max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """One row per source of (source, tokens) rows: source, tokens, weight, budget.

    The driver holds one number per source; a table of sources is taken to fit there.
    """
    rows = sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()
    rows = sorted(rows, key=lambda r: (r.source is not None, str(r.source)))
    counts = [r.tokens for r in rows]
    total = budget if budget is not None else float(sum(counts))
    weights = weights_at(counts, bisect_exponent(counts, total, entropy, max_repeats)) if sum(counts) else [0.0] * len(rows)
    kind = sized.schema["source"].dataType.simpleString()
    return sized.sparkSession.createDataFrame(
        [(r.source, int(r.tokens), w, round(w * total)) for r, w in zip(rows, weights)],
        f"source {kind}, tokens long, weight double, budget long")


def _uniform(*parts: str | Column) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def draw(sized: DataFrame, budget: float | None = None, entropy: float | None = ENTROPY,
         max_repeats: float | None = MAX_REPEATS, seed: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The drawn copies of (id, source, tokens) rows: id, source, tokens, mix_pass, mix_block, mix_key."""
    sized = stored(sized.groupBy("id", "source").agg(F.sum("tokens").alias("tokens")), "mix-sizes")
    passes = (plan_weights(sized, budget, entropy, max_repeats).where("budget > 0")
              .withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("budget") - 1) / F.col("tokens")))))
              .select(F.col("source").alias("_source"), "mix_pass", F.col("tokens").alias("_total"), F.col("budget").alias("_budget"),
                      F.least("tokens", F.col("budget") - F.col("mix_pass") * F.col("tokens")).alias("_rest"),
                      F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).alias("_blocks")))
    # one row per source and pass, as many as the driver has just handed out
    placed = (sized.join(F.broadcast(passes), F.col("source").eqNullSafe(F.col("_source")))
              .withColumn("_block", F.floor(_uniform(F.lit(seed), "mix_pass", "id") * F.col("_blocks")).cast("long"))
              .withColumn("_order", _uniform(F.lit(seed), "mix_pass", "id", F.lit("order"))))
    unit = ["_source", "mix_pass", "_block"]
    shuffled = Window.partitionBy("_source", "mix_pass").orderBy(_uniform(F.lit(seed), "mix_pass", "_source", "_block"), "_block")
    blocks = (placed.groupBy(*unit, "_rest", "_total").agg(F.sum("tokens").alias("_size"))
              .withColumn("_place", F.row_number().over(shuffled) - 1)  # one row per block
              .withColumn("_before", F.sum("_size").over(shuffled) - F.col("_size"))
              .where((F.col("_before") < F.col("_rest")) | (F.col("_rest") == F.col("_total"))))
    blocks = blocks.select(*[F.col(c).alias(f"_of{c}") for c in unit], F.col("_place").cast("long").alias("mix_block"),
                           (F.col("_rest") - F.col("_before")).alias("_left"), "_size")
    met = placed.join(blocks, F.col("_source").eqNullSafe(F.col("_of_source")) & (F.col("mix_pass") == F.col("_ofmix_pass"))
                      & (F.col("_block") == F.col("_of_block")))
    inside = Window.partitionBy(*unit).orderBy("_order", "id").rowsBetween(Window.unboundedPreceding, -1)
    ended = (met.where("_size > _left").withColumn("_so_far", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
             .where("_so_far < _left").drop("_so_far"))
    return met.where("_size <= _left").unionByName(ended).select(
        "id", "source", "tokens", "mix_pass", "mix_block",
        ((F.col("mix_pass") + (F.col("mix_block") + F.col("_order")) / F.col("_blocks")) / (F.col("_budget") / F.col("_total"))).alias("mix_key"))


def sizes(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, tokens) of documents; ``tokens`` defaults to the words of ``text``."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       (word_count() if tokens is None else tokens).alias("tokens"))


def mix(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id", source_col: str = "source", **settings) -> DataFrame:
    """The documents that are drawn, as often as they are drawn, with mix_pass, mix_block and mix_key."""
    drawn = draw(sizes(docs, tokens, id_col, source_col), **settings).select(
        F.col("id").alias("_id"), F.col("source").alias("_source"), "mix_pass", "mix_block", "mix_key")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_source"))
    return docs.drop("mix_pass", "mix_block", "mix_key").join(drawn, same).drop("_id", "_source")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = draw(sizes(table(spark, sf_dir, "documents")))
    return drawn.select(F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "mix_pass", "mix_block", "mix_key")


def _uniform_sql(*parts: str) -> str:
    joined = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"(CAST(CAST('0x' || substr(md5({joined}), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE)"


OP1_SQL = f"""WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f]+'), lambda w: w <> ''))) AS BIGINT) AS tokens
  FROM documents GROUP BY doc_id, source),
src AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS t FROM sized GROUP BY source),
given AS (SELECT CAST(sum(t) AS DOUBLE) AS total, list(CAST(t AS DOUBLE) ORDER BY t) AS ts FROM src WHERE t > 0),
shares AS (SELECT total, ts, list_transform(ts, lambda x: x / total) AS p FROM given),
found AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo_e, 1.0::DOUBLE AS hi_e, 0.0::DOUBLE AS lo_r, 1.0::DOUBLE AS hi_r UNION ALL
  SELECT step + 1,
    CASE WHEN meets_e THEN lo_e ELSE me END, CASE WHEN meets_e THEN me ELSE hi_e END,
    CASE WHEN meets_r THEN lo_r ELSE mr END, CASE WHEN meets_r THEN mr ELSE hi_r END
  FROM (SELECT *,
      ln(z) - me / z * list_sum(list_transform(p, lambda x: pow(x, me) * ln(x))) <= {ENTROPY}::DOUBLE * ln(len(p)) AS meets_e,
      list_max(list_transform(p, lambda x: pow(x, mr) / x)) / list_sum(list_transform(p, lambda x: pow(x, mr))) <= {MAX_REPEATS}::DOUBLE AS meets_r
    FROM (SELECT *, list_sum(list_transform(p, lambda x: pow(x, me))) AS z FROM (
      SELECT found.*, p, CASE step WHEN 0 THEN 0 ELSE (lo_e + hi_e) / 2 END AS me, CASE step WHEN 0 THEN 0 ELSE (lo_r + hi_r) / 2 END AS mr
      FROM found, shares WHERE step < {STEPS + 1})))),
power AS (SELECT CASE WHEN len(p) < 2 THEN 1 ELSE greatest(hi_e, hi_r) END AS a, total, p FROM found, shares WHERE step = {STEPS + 1}),
plan AS (
  SELECT source, t, CAST(round(pow(t / total, a) / list_sum(list_transform(p, lambda x: pow(x, a))) * total) AS BIGINT) AS budget
  FROM src, power WHERE t > 0),
passes AS (
  SELECT source, t, budget, mix_pass, least(t, budget - mix_pass * t) AS rest, greatest(1, CAST(ceil(t / {BLOCK_TOKENS}) AS BIGINT)) AS blocks
  FROM (SELECT *, unnest(range(0, (budget - 1) // t + 1)) AS mix_pass FROM plan WHERE budget > 0)),
placed AS (
  SELECT d.doc_id, d.source, d.tokens, mix_pass, rest, blocks, t, budget,
    CAST(floor({_uniform_sql("1", "mix_pass", "doc_id")} * blocks) AS BIGINT) AS block, {_uniform_sql("1", "mix_pass", "doc_id", "'order'")} AS ord
  FROM sized d JOIN passes ON d.source IS NOT DISTINCT FROM passes.source),
blocked AS (
  SELECT *, row_number() OVER w - 1 AS mix_block, sum(size) OVER w - size AS before
  FROM (SELECT source, mix_pass, block, rest, t, sum(tokens) AS size FROM placed GROUP BY ALL)
  WINDOW w AS (PARTITION BY source, mix_pass ORDER BY {_uniform_sql("1", "mix_pass", "source", "block")}, block)),
met AS (
  SELECT p.*, mix_block, b.rest - before AS room, size, sum(p.tokens) OVER (PARTITION BY p.source, p.mix_pass, p.block ORDER BY ord, doc_id) - p.tokens AS so_far
  FROM placed p JOIN blocked b ON p.source IS NOT DISTINCT FROM b.source AND p.mix_pass = b.mix_pass AND p.block = b.block
  WHERE before < b.rest OR b.rest = b.t)
SELECT doc_id, source, tokens AS n_tokens, mix_pass, mix_block, (mix_pass + (mix_block + ord) / blocks) / (budget / t) AS mix_key
FROM met WHERE size <= room OR so_far < room"""

QUERIES = {"op1_temperature_mix": (op1, OP1_SQL)}
