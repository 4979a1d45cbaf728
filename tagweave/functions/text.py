"""Splitting and normalising keyword strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the results depend on them -------------------------------
# ordered, case-sensitive substring rewrites
SYNONYMS = (
    ("Nz Transport Agency", "NZTA"),
    ("annual average daily traffic", "AADT"),
    ("greenhouse gas emission", "greenhouse gas"),
    ("emission greenhouse", "greenhouse gas"),
)
# repeated once labels have been lemmatised
SYNONYMS_AFTER_LEMMA = (("emission greenhouse", "greenhouse gas"),)
STOP_KEYWORDS = ("new zeal", "road", "transport")
# ----------------------------------------------------------------------------

# (?d): only a line feed ends a line; (?U): Unicode character classes
PARENTHESES = r"(?d)\(.*\)"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
PUNCTUATION = r"(?U)[^\w\s\x1c-\x1f]"

# English plural rules for the last word of a label, first match wins. Ours:
# exceptions come first, then suffix rewrites. A word shorter than four letters
# is left alone.
IRREGULAR_PLURALS = {
    "analyses": "analysis",
    "buses": "bus",
    "calves": "calf",
    "children": "child",
    "crises": "crisis",
    "criteria": "criterion",
    "data": "data",
    "feet": "foot",
    "gases": "gas",
    "geese": "goose",
    "halves": "half",
    "hypotheses": "hypothesis",
    "indices": "index",
    "knives": "knife",
    "leaves": "leaf",
    "lives": "life",
    "loaves": "loaf",
    "matrices": "matrix",
    "men": "man",
    "mice": "mouse",
    "news": "news",
    "people": "person",
    "phenomena": "phenomenon",
    "selves": "self",
    "series": "series",
    "shelves": "shelf",
    "shoes": "shoe",
    "species": "species",
    "teeth": "tooth",
    "theses": "thesis",
    "vertices": "vertex",
    "wives": "wife",
    "wolves": "wolf",
    "women": "woman",
}
PLURAL_SUFFIXES = (
    (r"(ss|us|is)\z", "$1"),
    (r"^(.)ies\z", "$1ie"),
    (r"ies\z", "y"),
    (r"(ss|sh|ch|x|zz)es\z", "$1"),
    (r"oes\z", "o"),
    (r"s\z", ""),
)


def split_keywords(col: Column) -> Column:
    """``;`` reads as ``,``; entries part at exactly comma-space, untrimmed."""
    return F.split(F.replace(col, F.lit(";"), F.lit(",")), ", ")


def explode_keywords(
    df: DataFrame, source: str = "key_words", out: str = "label"
) -> DataFrame:
    """One row per report and keyword. Null lists vanish, empty strings stay."""
    return df.withColumn(out, F.explode(split_keywords(F.col(source)))).dropna(
        subset=[out]
    )


def flatten_keywords(df: DataFrame, source: str, out: str = "nodes") -> DataFrame:
    """A single column of keywords from an array column of any declared depth."""
    depth = 0
    kind = df.schema[source].dataType
    while kind.typeName() == "array":
        kind, depth = kind.elementType, depth + 1
    col = F.col(source)
    for _ in range(depth - 1):
        # flatten yields null if any inner list is null; an empty list stands in
        col = F.flatten(F.transform(col, lambda x: F.coalesce(x, F.array())))
    return df.select(F.explode(col).alias(out)).dropna(subset=[out])


# letters, marks, digits and connectors make up words
WORD_SIGN = r"\p{L}\p{M}\p{Nd}\p{Pc}"


def replace_all(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Literal substring rewrites, applied one after the other."""
    for old, new in rules:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def apply_synonyms(
    col: Column, rules: Sequence[tuple[str, str]] = SYNONYMS
) -> Column:
    return replace_all(col, rules)


def strip_markup(col: Column, whole_word: bool = False) -> Column:
    """Drop parentheses, ``&``, ``:`` and ``and``; collapse runs of whitespace.

    ``and`` goes as a substring ("land use" becomes "l use"), as existing
    results have it; ``whole_word=True`` drops only the word.
    """
    col = F.regexp_replace(col, PARENTHESES, "")
    col = replace_all(col, [("&", " "), (":", " ")])
    if whole_word:
        col = F.regexp_replace(col, f"(?<![{WORD_SIGN}])and(?![{WORD_SIGN}])", "")
    else:
        col = replace_all(col, [("and", "")])
    return F.regexp_replace(col, WHITESPACE, " ")


def strip_punctuation(col: Column) -> Column:
    return F.regexp_replace(col, PUNCTUATION, "")


def drop_stop_words(col: Column, words: Sequence[str]) -> Column:
    """Remove words inside a label; what is left is joined by single spaces."""
    parts = F.split(F.trim(F.regexp_replace(col, WHITESPACE, " ")), " ")
    return F.array_join(F.filter(parts, lambda w: ~w.isin(*words)), " ")


def is_acronym(col: Column) -> Column:
    """Upper case throughout, with at least one letter."""
    return (col == F.upper(col)) & (col != F.lower(col))


def decapitalize(col: Column) -> Column:
    """Lower-case the first character, except in acronyms."""
    rest = F.concat(F.lower(F.substring(col, 1, 1)), F.substring(col, 2, 2**31 - 1))
    return F.when(is_acronym(col), col).otherwise(rest)


def first_token(col: Column) -> Column:
    """Text before the first space or comma."""
    return F.split(col, "[ ,]")[0]


def paper_number(col: Column) -> Column:
    """First run of digits as a number; null if there is none."""
    digits = F.nullif(F.regexp_extract(col, "[0-9]+", 0), F.lit(""))
    return digits.try_cast("double")


def singularize_labels(
    df: DataFrame,
    col: str,
    out: str | None = None,
    exceptions: dict[str, str] | None = None,
) -> DataFrame:
    """Singular form of each label's last word; acronyms are exempt.

    A chain of row-wise expressions: as no library has to be called there is
    nothing to gain from a separate pass over the distinct labels.
    """
    irregular = F.create_map(
        *[F.lit(x) for kv in {**IRREGULAR_PLURALS, **(exceptions or {})}.items() for x in kv]
    )
    word = F.col("_last_word")
    singular = word
    for pattern, replacement in reversed(PLURAL_SUFFIXES):
        singular = F.when(
            word.rlike(pattern), F.regexp_replace(word, pattern, replacement)
        ).otherwise(singular)
    singular = F.when(F.length(word) < 4, word).otherwise(singular)
    # the pieces are columns of their own, so that no expression is repeated
    parts = df.withColumn("_source", F.col(col)).withColumn(
        "_last_word", F.regexp_extract("_source", r"([^ ]*)\z", 1)
    )
    head = F.expr("left(_source, length(_source) - length(_last_word))")
    result = F.when(is_acronym(F.col("_source")), F.col("_source")).otherwise(
        F.concat(head, F.coalesce(F.try_element_at(irregular, word), singular))
    )
    return parts.withColumn(out or col, result).drop("_source", "_last_word")


def clean_labels(
    df: DataFrame,
    col: str = "label",
    out: str = "new_label",
    synonyms: Sequence[tuple[str, str]] = SYNONYMS,
    whole_word: bool = False,
) -> DataFrame:
    """The whole normalisation: markup, synonyms, first letter, singular, case."""
    df = df.withColumn(
        out, apply_synonyms(strip_markup(F.col(col), whole_word), synonyms)
    )
    df = df.withColumn(out, decapitalize(F.col(out)))
    df = singularize_labels(df, out)
    return df.withColumn(out, F.lower(out))
