"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

DataFrame functions only. A source's target is a number of words; whole passes
over the source (epochs) come first, and the rest is drawn without replacement
with probabilities that follow the documents' quality weights: each document
gets the exponential key -ln(u) / weight, with u from a hash of seed and id, and
the documents with the smallest keys are taken until their running total
reaches the rest. The last one is taken if that comes nearer to the target.

Running totals are made over ranges of (source, key), so a source of any size
is spread over many tasks.

Defined cases: a null source is a source of its own, ordered last; a null or
blank text has size 0 and is never taken; a null id hashes as an empty string; rows
that repeat an id have equal keys and count each for itself; texts of any length are counted whole, in their row;
an empty table or one without words gives targets of 0; other columns play no part in ``mix``, whatever
their names, and ``take_mix`` returns them as they are (columns of map type cannot be hashed and are an error there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import running_totals, stored, table, unused, word_count

WEIGHTS = (5, 2, 1)
SEED = 17
MAX_EPOCHS = 3


def quality_weight(text: Column) -> Column:
    """1 for a text without symbols, less the more of its characters are symbols; 1 for none."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return F.when(F.length(text) > 0, F.length(text) / (F.length(text) + 100 * symbols)).otherwise(F.lit(1.0))


def sample_key(id: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1] from 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(2.0**52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, rank, size, target) from one row (source, size) per source.

    Sources by code point, null last, weigh ``weights``, repeating. The total
    size is shared by weight; no target exceeds ``max_epochs`` times its
    source's size, and what is over is shared among the others by weight. That
    is one level L with target = least(max_epochs * size, L * weight): with the
    sources sorted by cap / weight, L follows from running totals.
    """
    named = sizes.select("source", "size", F.col("source").isNull().cast("long").alias("last"), F.coalesce("source", F.lit("")).alias("name"), F.lit(1).cast("long").alias("one"))
    named = running_totals(named, [], ["last", "name"], "one", "rank").drop("last", "name")
    choice = F.lit(weights[-1])
    for i, w in list(enumerate(weights))[:-1]:
        choice = F.when(F.col("rank") % len(weights) == i, w).otherwise(choice)
    weighed = named.select("source", "rank", "size", choice.cast("long").alias("weight"), (F.col("size") * max_epochs).alias("cap"))
    weighed = stored(weighed.withColumn("ratio", F.col("cap") / F.col("weight")), "weights")
    sums = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    before = running_totals(running_totals(weighed, [], ["ratio", "rank"], "cap", "caps"), [], ["ratio", "rank"], "weight", "used")
    level = (F.lit(sums["size"] or 0) - F.col("caps")) / (F.lit(sums["weight"] or 0) - F.col("used"))
    found = before.where(level <= F.col("ratio")).agg(F.min(F.struct("ratio", "rank", level.alias("level"))).alias("x")).first()["x"]
    return weighed.select("source", "rank", "size", F.least(F.col("cap").cast("double"), F.lit(float(found["level"]) if found else 0.0) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, row_key: Column | None = None) -> DataFrame:
    """One row per document: ``id``, size, source_size, target (words, of its source), epochs, sampled, copies, taken.

    ``copies`` is how often the document is in the mix, ``taken`` the words that makes. ``row_key``
    comes back in a column ``row_key``.
    """
    weight = quality_weight(F.col(text)) if quality is None else quality
    sized = stored(
        docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), sample_key(F.col(id), weight, seed).alias("key"), *([] if row_key is None else [row_key.alias("row_key")])),
        "sized",
    )
    targets = stored(source_targets(stored(sized.groupBy("source").agg(F.sum("size").alias("size")), "sources"), weights), "targets")
    of_source = targets.select(F.col("source").alias("s"), "rank", F.col("size").alias("source_size"), "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = sized.join(of_source, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source").withColumn("epochs", whole)
    rows = running_totals(rows, ["rank"], ["key", "id", "size"], "size", "before")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    over = F.col("before") + F.col("size") - rest
    sampled = (F.col("size") > 0) & ((over <= 0) | (over < rest - F.col("before")))
    copies = F.when(F.col("size") > 0, F.col("epochs") + sampled.cast("long")).otherwise(F.lit(0)).cast("long")
    return rows.select(
        F.col("id").alias(id),
        "size",
        "source_size",
        "target",
        "epochs",
        sampled.alias("sampled"),
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
        *([] if row_key is None else ["row_key"]),
    )


def take_mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` in the mix, each as often as the mix takes it.

    Rows are found again by a hash of 128 bits over all their columns. Equal rows
    are one row, repeated as often as the mix takes all of them together.
    """
    copies, at, key = (unused(docs.columns, c) for c in ("_copies", "_copy", "_key"))
    everything = [c for name in docs.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    row_key = F.struct(*[F.xxhash64(F.lit(salt), *everything).alias(f"h{salt}") for salt in (1, 2)])
    mixed = mix(docs, id, text, source, row_key=row_key)
    chosen = stored(mixed.groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(at)).where(F.col(copies) > 0), "mix")
    joined = docs.withColumn(key, row_key).join(chosen, key)
    if not chosen.where(F.col(at) > 1).isEmpty():
        joined = joined.where(F.col(at) == 1).unionByName(joined.where(F.col(at) > 1).dropDuplicates([key]))
    return joined.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "epochs", "sampled")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN length(text) > 0 THEN length(text) / (length(text) + 100 * (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))) ELSE 1.0 END AS w,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1) / pow(2, 52) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source
), k AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * size AS cap FROM s
), r AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
         sum(size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights
  FROM k
), l AS (
  SELECT first((total - caps) / (weights - used) ORDER BY ratio, rank) AS level FROM r WHERE (total - caps) / (weights - used) <= ratio
), t AS (
  SELECT source, size AS source_size, least(cap::DOUBLE, coalesce(level, 0.0) * weight) AS target FROM r, l
), e AS (
  SELECT doc_id, d.size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, target - epochs * source_size AS rest FROM e
), f AS (
  SELECT *, size > 0 AND (before + size - rest <= 0 OR before + size - rest < rest - before) AS sampled FROM c
)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (epochs + sampled::INT))::BIGINT AS taken, epochs, sampled FROM f
"""
