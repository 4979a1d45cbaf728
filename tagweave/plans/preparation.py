"""From a catalogue's raw keyword strings to report keywords, through a vocabulary.

Labels repeat; their forms depend on nothing but the label. So the distinct labels are
collected with ids and counts, every transformation runs once per label, and
the finished forms are joined back to the reports. Both stages that
are written, lemmas and stems, come from that one pass. Who only asks which reports share stems
joins numbers back instead of spelled forms.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.text import (
    SYNONYMS,
    clean_labels,
    explode_keywords,
    first_token,
    singularize_labels,
)
from tagweave.functions.vocabulary import lemmatize_labels, stem_labels
from tagweave.operators.lineage import settle
from tagweave.operators.ranking import dense_id
from tagweave.sources.writers import write_nodes, write_report_keywords

FORMS = ("new_label", "stemmed_version")


@dataclass(frozen=True)
class Prepared:
    """``vocabulary``: (id, label, n_reports, new_label, stemmed_version), one row per label.

    ``stems``: the catalogue's columns without the raw strings, one row per report and label, with
    ``new_theme`` and the forms. ``labels``: the same rows before the forms are joined, settled.
    """

    vocabulary: DataFrame
    stems: DataFrame
    labels: DataFrame

    @property
    def lemmas(self) -> DataFrame:
        return self.stems.drop("stemmed_version")

    def stem_ids(self, report: str) -> DataFrame:
        """``(report, stem_id)``, one row per report and label; labels with one stem have one id."""
        same = Window.partitionBy("stemmed_version")
        ids = settle(self.vocabulary.select("label", F.min("id").over(same).alias("stem_id")))
        return self.labels.select(report, "label").join(ids, "label").select(report, "stem_id")

    @property
    def nodes(self) -> DataFrame:
        """Keyword nodes: ``id``, ``nodes``, ``n_reports`` and a singular ``label``."""
        named = self.vocabulary.select("id", F.col("label").alias("nodes"), "n_reports", F.lower("label").alias("label"))
        return singularize_labels(named, "label")


def vocabulary_of(rows: DataFrame, col: str = "label") -> DataFrame:
    """``(id, label, n_reports)``: distinct labels, 0-based ids in their order, rows with each."""
    counted = rows.groupBy(F.col(col).alias("label")).agg(F.count("*").alias("n_reports"))
    return dense_id(counted, ["label"], start=0).select("id", "label", "n_reports")


def label_forms(
    vocabulary: DataFrame,
    lemmas: DataFrame | None = None,
    synonyms: Sequence[tuple[str, str]] = SYNONYMS,
    whole_word: bool = False,
) -> DataFrame:
    """``vocabulary`` with the cleaned (and lemmatised) ``new_label`` and its stem."""
    formed = clean_labels(vocabulary, "label", "new_label", synonyms, whole_word)
    if lemmas is not None:
        formed = lemmatize_labels(formed, lemmas)
    return stem_labels(formed, "new_label")


def prepare_report_keywords(
    catalogue: DataFrame,
    lemmas: DataFrame | None = None,
    synonyms: Sequence[tuple[str, str]] = SYNONYMS,
    whole_word: bool = False,
    keywords: str = "key_words",
    theme: str = "theme",
) -> Prepared:
    """Split, clean, lemmatise and stem the keywords of a catalogue.

    Reports without keywords have no rows. A label that very many reports carry is one row of
    the vocabulary; the join back splits it (AQE) where the vocabulary is not broadcast.
    """
    # building the catalogue can be a long job of its own
    exploded = settle(explode_keywords(catalogue, keywords).drop(keywords))
    formed = settle(label_forms(vocabulary_of(exploded), lemmas, synonyms, whole_word))
    stems = exploded.join(formed.select("label", *FORMS), "label")
    if theme in catalogue.columns:
        stems = stems.withColumn("new_theme", first_token(F.col(theme)))
    return Prepared(formed, stems, exploded)


def write_prepared(prepared: Prepared, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Keyword nodes and both stages, below ``path``."""
    write_nodes(prepared.nodes, f"{path}/nodes", fmt, mode)
    write_report_keywords(prepared.lemmas, f"{path}/lemmas", fmt, mode)
    write_report_keywords(prepared.stems, f"{path}/stems", fmt, mode)
