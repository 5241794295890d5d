"""Host-level quality rules: failures counted by host, rates shrunk with a beta prior, verdicts joined back.

DataFrame functions only. Every measure of a text is an expression over its
own row, so no text is shuffled and a text of any length stays in one row; the
hosts' counts are ordinary aggregates (partial sums before the shuffle).

Defined cases: a null or blank text has no words and fails ``too_short``. Rows
without a host (null) form no host: they are judged by their own rules only. Repeated rows
count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, let, stored, table, unused, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected when this share of its documents fails a rule, and the shrunk rate is above it by DEVIATIONS or more.
MAX_HOST_RATE = 0.5
DEVIATIONS = 2
#: Strength of the prior (in documents) is kept within these bounds.
PRIOR_STRENGTH = (2.0, 1e6)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words covered by windows of ``window`` words that occur twice or more in the array.

    Windows are compared by a 64-bit hash of their words. Sorting brings equal
    ones together, so the cost is n log n in the length of the text; the
    places are only looked up in texts that do repeat a window.
    """

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            repeated = F.filter(s, lambda e, i: e["h"].eqNullSafe(F.get(s, i - 1)["h"]) | e["h"].eqNullSafe(F.get(s, i + 1)["h"]))
            return let(
                F.sort_array(F.transform(repeated, lambda e: e["i"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window)))),
                    F.lit(0),
                    lambda a, b: a + b,
                ),
            )

        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)

    hashes = let(
        words,
        lambda w: F.when(
            F.size(w) >= window,
            F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window))),
        ),
    )
    return let(
        hashes,
        lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(covered(h)),
    ).cast("long")


def measures(text: Column, only: list[str] = MEASURES) -> Column:
    """A struct of the counts ``only`` (long) for one text."""
    whole = F.coalesce(text, F.lit(""))
    repeated_lines = let(
        F.filter(F.split(whole, "\n"), lambda line: F.trim(line, F.lit(SPACES)) != ""),
        lambda a: F.size(a) - F.size(F.array_distinct(a)),
    )

    def of_words(w: Column) -> Column:
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")),
            "n_dup_lines": repeated_lines,
            "n_repeat_words": repeat_words(w),
        }
        return F.struct(*[counts[c].cast("long").alias(c) for c in only])

    return let(words_of(text), of_words)


def base_rules(m: Column) -> dict[str, Column]:
    """The rules that fail a document by itself."""
    return {
        "too_short": m["n_words"] < MIN_WORDS,
        "repeated": m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT,
    }


def base_failed(text: Column) -> Column:
    """Whether a text fails a rule by itself, as one expression that is worked out once per row."""
    return let(measures(text, ["n_words", "n_repeat_words"]), lambda m: F.greatest(*base_rules(m).values()))


def host_rules(m: Column) -> dict[str, Column]:
    """The rules counted by host: the document rules, and two that only speak about hosts."""
    return base_rules(m) | {
        "symbols": m["n_symbols"] * 10 > m["word_chars"],
        "dup_lines": m["n_dup_lines"] * 20 > m["n_words"],
    }


def beta_prior(counts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """Per rule (alpha, beta), fitted to all hosts' rates by moments.

    The prior's mean is the overall rate. Its strength comes from the variance
    of the hosts' rates (weighted by documents) beyond what sampling explains.
    One row of sums, whatever the number of hosts, reaches the driver.
    """
    n = F.col("n").cast("double")
    total, hosts = F.sum("n").alias("n"), F.count("*").alias("hosts")
    parts = []
    for r in rules:
        f = F.col(r).cast("double")
        parts += [F.sum(r).alias(f"f_{r}"), F.sum(f * f / n).alias(f"s_{r}")]
    row = counts.agg(total, hosts, *parts).first()
    out = {}
    for r in rules:
        if not row["n"]:
            out[r] = (1.0, 1.0)
            continue
        mean = row[f"f_{r}"] / row["n"]
        spread = row[f"s_{r}"] / row["n"] - mean * mean
        between = spread - mean * (1 - mean) * row["hosts"] / row["n"]
        strength = PRIOR_STRENGTH[1] if between <= 0 else mean * (1 - mean) / between - 1
        strength = min(max(strength, PRIOR_STRENGTH[0]), PRIOR_STRENGTH[1])
        out[r] = (mean * strength, (1 - mean) * strength)
    return out


def host_verdicts(measured: DataFrame, host: str, m: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: n (documents), failures and shrunk rate of every rule, and ``rejected``.

    The shrunk rate is the mean of the beta distribution that prior and host
    make together. A host is only rejected by its own failures, and only when
    there are enough documents to be sure.
    """
    rules = host_rules(F.col(m))
    counts = stored(
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(r) for r, c in rules.items()]),
        "host-counts",
    )
    columns, bad, rates = [], F.lit(False), []
    for r, (a, b) in beta_prior(counts, list(rules)).items():
        size = F.col("n") + F.lit(a + b)
        rate = (F.col(r) + F.lit(a)) / size
        sure = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (size + 1)) >= max_rate
        bad = bad | (sure & (F.col(r) >= F.col("n") * max_rate))
        columns.append(rate.alias(f"{r}_rate"))
        rates.append(rate)
    return counts.select("host", "n", *rules, *columns, F.greatest(*rates).alias("worst_rate"), bad.alias("rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with MEASURES, base_failed, host_docs, host_worst_rate, host_rejected and kept.

    Measures that carry a name of ``docs`` replace nothing: the input column
    is left out of the result, so name what to keep. The host table is joined
    by Spark's own choice; its size is not assumed. Texts are read twice when
    kept, once for the hosts and once for the result; they are not shuffled
    unless the host table is too large to send to every task.
    """
    keep = docs.columns if keep is None else keep
    m, key = unused(docs.columns, "_measures"), unused(docs.columns, "_host")
    columns = list(dict.fromkeys([*keep, host]))
    measured = docs.select(*columns, measures(F.col(text)).alias(m))
    if text not in keep:
        measured = stored(measured, "measures")
    verdicts = host_verdicts(measured, host, m, max_rate).select(
        F.col("host").alias(key), F.col("n").alias("host_docs"), F.col("worst_rate").alias("host_worst_rate"), F.col("rejected").alias("host_rejected")
    )
    failed = F.greatest(*base_rules(F.col(f"measured.{m}")).values())
    rejected = F.coalesce(F.col("v.host_rejected"), F.lit(False))
    added = [*MEASURES, "base_failed", "host_docs", "host_worst_rate", "host_rejected", "kept"]
    return measured.alias("measured").join(verdicts.alias("v"), F.col(f"measured.{host}") == F.col(f"v.{key}"), "left").select(
        *[F.col(f"measured.{c}") for c in keep if c.lower() not in {a.lower() for a in added}],
        *[F.col(f"measured.{m}.{c}").alias(c) for c in MEASURES],
        failed.alias("base_failed"),
        F.col("v.host_docs").alias("host_docs"),
        F.col("v.host_worst_rate").alias("host_worst_rate"),
        rejected.alias("host_rejected"),
        (~failed & ~rejected).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows and columns of ``docs`` that the rules keep."""
    m = unused(docs.columns, "_measures")
    key = unused([*docs.columns, m], "_host")
    measured = docs.select(host, measures(F.col(text)).alias(m))
    rejected = host_verdicts(measured, host, m, max_rate).where("rejected").select(F.col("host").alias(key))
    good = docs.where(~base_failed(F.col(text)))
    return good.join(rejected, good[host] == rejected[key], "left_anti")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.withColumn("host_worst_rate", F.round("host_worst_rate", 6))


_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines,
         row_number() OVER () AS rid
  FROM documents
), wins AS (
  SELECT rid, i, list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1
), cover AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), m AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words,
         length(list_aggregate(list_concat([''], w), 'string_agg', ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cover USING (rid)
), r AS (
  SELECT *, n_words < {MIN_WORDS} AS too_short, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS repeated,
         n_symbols * 10 > word_chars AS symbols, n_dup_lines * 20 > n_words AS dup_lines
  FROM m
), h AS (
  SELECT source, rule, count(*) AS n, sum(f::INT) AS f
  FROM (SELECT source, unnest(['too_short', 'repeated', 'symbols', 'dup_lines']) AS rule,
               unnest([too_short, repeated, symbols, dup_lines]) AS f FROM r WHERE source IS NOT NULL)
  GROUP BY source, rule
), p AS (
  SELECT rule, sum(f) / sum(n) AS mean, sum(f::DOUBLE * f / n) / sum(n) - (sum(f) / sum(n)) ^ 2
           - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS between_var
  FROM h GROUP BY rule
), k AS (
  SELECT rule, mean, CASE WHEN between_var <= 0 THEN {PRIOR_STRENGTH[1]}
           ELSE least(greatest(mean * (1 - mean) / between_var - 1, {PRIOR_STRENGTH[0]}), {PRIOR_STRENGTH[1]}) END AS strength
  FROM p
), v AS (
  SELECT source, max(n) AS host_docs, max(rate) AS worst,
         bool_or(f >= n * {MAX_HOST_RATE} AND rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (n + strength + 1)) >= {MAX_HOST_RATE}) AS rejected
  FROM (SELECT source, n, f, strength, (f + mean * strength) / (n + strength) AS rate FROM h JOIN k USING (rule)) GROUP BY source
)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       too_short OR repeated AS base_failed, v.host_docs, round(v.worst, 6) AS host_worst_rate,
       coalesce(v.rejected, false) AS host_rejected,
       NOT (too_short OR repeated) AND NOT coalesce(v.rejected, false) AS kept
FROM r LEFT JOIN v ON r.source = v.source
"""
