"""Quality rules: base rules and a hashed n-gram likelihood ratio.

Everything runs in DataFrame expressions. Words are maximal runs without ASCII
white space. Unigrams and bigrams of words are hashed into ``2 ** bits`` buckets.
A multinomial over the buckets is counted on all documents (add-one smoothing) and one on
trusted documents, smoothed towards the first by ``PRIOR`` pseudo-counts a bucket, so that a
bucket without evidence has the ratio one. A text's score is the sum over its n-grams of
log(target / raw), divided by their number. Documents below ``threshold`` are
rejected; each is decided by the same rule.

Trusted are documents that ``labels`` marks with quality 1 and not toxic, at most
``max_trusted`` of them (smallest hash of the id, then id), which bounds what is
broadcast. The raw counts cover every document. Without trusted documents every
ratio is zero and the base rules alone decide.

Null and empty texts have no words, score 0 and fail the base rules. Repeated rows
are judged one by one and count one by one; null ids are never trusted. Other columns
pass through; a column with a name in ``ADDED`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import SPACE_CLASS, SPACES
from tagweave.operators.lineage import discard, settle

BITS = 13
MAX_TRUSTED = 20_000
PRIOR = 1.0
THRESHOLD = -0.08
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
ADDED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "ratio", "kept",
)


def split_words(text: str | Column) -> Column:
    """Words of a text; none for a null or blank one."""
    bare = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, SPACE_CLASS + "+")
    )


def buckets(words: str, bits: int = BITS) -> Column:
    """Bucket of each word, then of each pair of neighbours."""
    mask = F.lit((1 << bits) - 1).cast("long")
    w = F.col(words)
    single = F.transform(w, lambda x: F.xxhash64(x).bitwiseAND(mask).cast("int"))
    pairs = F.transform(
        F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
        lambda x, i: F.xxhash64(F.get(w, i), x).bitwiseAND(mask).cast("int"),
    )
    return F.concat(single, pairs)


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """``(doc_id)`` of trusted documents, a bounded number whatever ``labels`` holds."""
    return (
        labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
        .where(F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_trusted)
    )


def ratio_table(
    docs: DataFrame, trusted: DataFrame, bits: int = BITS
) -> tuple[list[float], bool]:
    """log(target / raw) per bucket, rounded to 9 places, and whether there is a target.

    ``2 ** bits`` numbers at most reach the driver. ``trusted`` must be bounded.
    """
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.withColumn("_t", F.lit(1))), "doc_id", "left"
    )
    counts = settle(
        marked.select("_t", split_words("text").alias("_w"))
        .select("_t", F.explode(buckets("_w", bits)).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.count("_t").alias("target"))
    )
    n = 1 << bits
    sums = counts.agg(
        F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"),
    ).first()

    def ratio(target: Column, raw: Column) -> Column:
        share = (raw + 1) / F.lit(float(sums.all_raw + n))
        smooth = (target + PRIOR * n * share) / F.lit(float(sums.all_target + PRIOR * n))
        return F.round(F.log(smooth) - F.log(share), 9)

    if not sums.all_target:
        discard(counts)
        return [0.0] * n, False
    rows = (
        counts.sparkSession.range(n)
        .join(counts, F.col("id") == F.col("b"), "left")
        .select("id", ratio(F.coalesce("target", F.lit(0)), F.coalesce("raw", F.lit(0))).alias("v"))
        .collect()
    )
    table = [0.0] * n
    for r in rows:
        table[r.id] = r.v
    discard(counts)
    return table, True


def repeat_words(words: str) -> Column:
    """Words inside a three-word window that the text has twice or more.

    Windows are compared by a 64-bit hash. Sorted by hash and place, equal windows
    are neighbours; the places found, in order, each add the words up to the next.
    """
    w = F.col(words)
    return F.when(F.size(w) >= 4, F.sort_array(
        F.transform(
            F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(1))),
            lambda x, i: F.struct(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), x).alias("h"), i.alias("i")
            ),
        )
    ))


def _repeated_places(windows: str) -> Column:
    s = F.col(windows)
    same = F.filter(
        s,
        lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]),
    )
    return F.sort_array(F.transform(same, lambda x: x["i"]))


def _covered(places: str) -> Column:
    p = F.col(places)
    return F.coalesce(
        F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
        F.lit(0).cast("long"),
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    bits: int = BITS,
    max_trusted: int = MAX_TRUSTED,
) -> DataFrame:
    """``docs`` with the columns ``ADDED``; ``kept`` is the verdict."""
    table, _ = ratio_table(docs, trusted_ids(labels, max_trusted), bits)
    # folded into one array constant of 2 ** bits numbers
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.drop(*ADDED)
    out = out.withColumn("_w", split_words("text")).withColumn("_l", lines)
    out = out.withColumns({"_s": repeat_words("_w"), "_b": buckets("_w", bits)})
    out = out.withColumn("_p", _repeated_places("_s"))
    total = F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    n = F.size("_w").cast("long")
    out = out.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": _covered("_p"),
            "ratio": F.when(F.size("_b") > 0, F.round(total / F.size("_b"), 9)).otherwise(0.0),
        }
    ).drop("_w", "_l", "_s", "_b", "_p")
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")),
    ).withColumn(
        "kept",
        # the partition number is always 0 or more; it keeps filters on these columns from being
        # moved below them, where each use would compute the texts' arrays again
        ~F.col("base_failed") & (F.col("ratio") >= threshold) & (F.spark_partition_id() >= 0),
    )
