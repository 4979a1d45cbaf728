"""Label-level word forms: lemmas from a table, stems by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import SYNONYMS_AFTER_LEMMA, apply_synonyms


def lemmatize_labels(
    df: DataFrame, lemmas: DataFrame, col: str = "new_label", out: str | None = None
) -> DataFrame:
    """Replace whole labels by their lemma; labels without one stay.

    ``lemmas`` has the columns ``surface`` and ``lemma``. The planner picks a
    broadcast join if the table is small; otherwise AQE splits a hot label.
    """
    table = lemmas.groupBy(F.col("surface").alias("_surface")).agg(
        F.min("lemma").alias("_lemma")
    )
    joined = df.join(table, df[col] == table["_surface"], "left")
    label = apply_synonyms(F.coalesce("_lemma", F.col(col)), SYNONYMS_AFTER_LEMMA)
    return joined.withColumn(out or col, label).drop("_surface", "_lemma")


# --- fixed values: suffix rules of Porter (1980), with the widely used later
# --- additions (short words, irregular forms, -ied, -fulli, -logi) -----------
IRREGULAR_STEMS = {
    "cannings": "canning",
    "canning": "canning",
    "dying": "die",
    "exceed": "exceed",
    "howe": "howe",
    "inning": "inning",
    "innings": "inning",
    "lying": "lie",
    "news": "news",
    "outing": "outing",
    "outings": "outing",
    "proceed": "proceed",
    "skies": "sky",
    "sky": "sky",
    "succeed": "succeed",
    "tying": "tie",
}
STEP_2 = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "bli": "ble",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
    "fulli": "ful",
    "logi": "log",
}
STEP_3 = {
    "icate": "ic",
    "ative": "",
    "alize": "al",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
# -----------------------------------------------------------------------------

# A word reads as [C](VC)^m[V]. ``y`` is a consonant at the start (marked "Y"
# below) and after a vowel, which the two classes express.
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
HAS_VOWEL = f"^({_C})?[aeiouy]"
MEASURE_POSITIVE = f"^({_C})?{_V}{_C}"
MEASURE_ONE = rf"^({_C})?{_V}{_C}({_V})?\z"
MEASURE_ABOVE_ONE = f"^({_C})?{_V}{_C}{_V}{_C}"
# consonant-vowel-consonant ending, as it can look in a stem of measure one
SHORT_STEM = rf"^({_C}[aeiouy][^aeiouwxy]|[aeiou][^aeiou])\z"
CONSONANT_END = r"([^aeiouy]|[aeiou]y)\z"


def _lookup(rules: dict[str, str], key: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    return F.try_element_at(table, F.col(key))


def _cut(df: DataFrame, suffixes) -> DataFrame:
    """Columns ``_stem`` and ``_suffix`` for the longest matching suffix."""
    pattern = r"(?s)^(.*?)(" + "|".join(suffixes) + r")\z"
    return df.withColumn("_stem", F.regexp_extract("_w", pattern, 1)).withColumn(
        "_suffix", F.regexp_extract("_w", pattern, 2)
    )


def _keep_unless(condition: Column, replacement: Column) -> Column:
    return F.when(condition, replacement).otherwise(F.col("_w"))


def stem_labels(
    df: DataFrame, col: str = "label", out: str = "stemmed_version"
) -> DataFrame:
    """Suffix-stem each whole label.

    The rules are regular expressions over one column, so no Python worker is
    needed. Each step is a projection of its own: the next one refers to its
    columns several times and must not repeat their work.
    """
    stem, suffix, w = F.col("_stem"), F.col("_suffix"), F.col("_w")
    df = df.withColumn("_word", F.lower(col)).withColumn(
        "_w", F.regexp_replace("_word", "^y", "Y")
    )

    # plural endings
    df = _cut(df, ["sses", "ies", "ss", "s"]).withColumn(
        "_w",
        F.when((suffix == "ies") & (F.length("_w") == 4), F.concat(stem, F.lit("ie")))
        .when(suffix == "ies", F.concat(stem, F.lit("i")))
        .when(suffix.isin("sses", "ss"), F.concat(stem, F.lit("ss")))
        .when(suffix == "s", stem)
        .otherwise(w),
    )

    # -ied, -eed, -ed, -ing; the last two leave a stem that may need repair
    df = _cut(df, ["ied", "eed", "ed", "ing"]).withColumn(
        "_repair", suffix.isin("ed", "ing") & stem.rlike(HAS_VOWEL)
    )
    df = df.withColumn(
        "_w",
        F.when((suffix == "ied") & (F.length("_w") == 4), F.concat(stem, F.lit("ie")))
        .when(suffix == "ied", F.concat(stem, F.lit("i")))
        .when(
            (suffix == "eed") & stem.rlike(MEASURE_POSITIVE),
            F.concat(stem, F.lit("ee")),
        )
        .when(F.col("_repair"), stem)
        .otherwise(w),
    )
    last = F.substring(w, -1, 1)
    doubled = (
        (F.length(w) > 1)
        & (last == F.substring(w, -2, 1))
        & ~last.isin(*"aeiouy")
    )
    df = df.withColumn(
        "_w",
        F.when(~F.col("_repair"), w)
        .when(w.rlike(r"(at|bl|iz)\z"), F.concat(w, F.lit("e")))
        .when(doubled & last.isin("l", "s", "z"), w)
        .when(doubled, F.expr("left(_w, length(_w) - 1)"))
        .when(w.rlike(MEASURE_ONE) & w.rlike(SHORT_STEM), F.concat(w, F.lit("e")))
        .otherwise(w),
    )

    # final y after a consonant that is not the first letter
    df = _cut(df, ["y"]).withColumn(
        "_w",
        _keep_unless(
            (suffix == "y") & (F.length(stem) > 1) & stem.rlike(CONSONANT_END),
            F.concat(stem, F.lit("i")),
        ),
    )

    # double and single derivational endings
    df = _cut(df, ["alli"]).withColumn(
        "_w",
        _keep_unless(
            (suffix == "alli") & stem.rlike(MEASURE_POSITIVE),
            F.concat(stem, F.lit("al")),
        ),
    )
    base = F.when(suffix == "logi", F.concat(stem, F.lit("l"))).otherwise(stem)
    df = _cut(df, STEP_2).withColumn(
        "_w",
        _keep_unless(
            (suffix != "") & base.rlike(MEASURE_POSITIVE),
            F.concat(stem, _lookup(STEP_2, "_suffix")),
        ),
    )
    df = _cut(df, STEP_3).withColumn(
        "_w",
        _keep_unless(
            (suffix != "") & stem.rlike(MEASURE_POSITIVE),
            F.concat(stem, _lookup(STEP_3, "_suffix")),
        ),
    )
    df = _cut(df, STEP_4).withColumn(
        "_w",
        _keep_unless(
            (suffix != "")
            & stem.rlike(MEASURE_ABOVE_ONE)
            & ((suffix != "ion") | stem.rlike(r"[st]\z")),
            stem,
        ),
    )

    # final e and double l
    df = _cut(df, ["e"]).withColumn(
        "_w",
        _keep_unless(
            (suffix == "e")
            & (
                stem.rlike(MEASURE_ABOVE_ONE)
                | (stem.rlike(MEASURE_ONE) & ~stem.rlike(SHORT_STEM))
            ),
            stem,
        ),
    )
    df = _cut(df, ["l"]).withColumn(
        "_w",
        _keep_unless(w.rlike(r"ll\z") & stem.rlike(MEASURE_ABOVE_ONE), stem),
    )

    short = F.length("_word") <= 2
    return df.withColumn(
        out,
        F.coalesce(
            F.when(short, F.col("_word")),
            _lookup(IRREGULAR_STEMS, "_word"),
            F.regexp_replace("_w", "^Y", "y"),
        ),
    ).drop("_word", "_w", "_stem", "_suffix", "_repair")


def stem_families(df: DataFrame, col: str = "label") -> DataFrame:
    """Labels per stem, with the most frequent one (first in order on ties)."""
    counts = stem_labels(df.groupBy(F.col(col).alias("label")).agg(F.count("*").alias("n")))
    return counts.groupBy("stemmed_version").agg(
        F.min_by("label", F.struct(-F.col("n"), "label")).alias("canonical"),
        F.count("*").alias("n_labels"),
        F.sum("n").alias("n_rows"),
    )
