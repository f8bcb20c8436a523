"""Unit, span and document predicates."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.text import contains_ci, like_ci
from spanloom.operators.evidence import support_at, support_gate
from spanloom.plans.corpus import Corpus

# --- fixed values: sample families ------------------------------------------
FAMILIES = ("single", "multi", "null", "fragments")
# --- end of fixed values ----------------------------------------------------


def name_list(raw: str | Iterable[str] | None) -> list[str]:
    """Comma-separated names, or a list of such, as one clean list."""
    if not raw:
        return []
    items = [raw] if isinstance(raw, str) else list(raw)
    return [name.strip() for item in items for name in item.split(",") if name.strip()]


@dataclass(frozen=True)
class UnitFilter:
    """All given conditions hold together; lists are any-of (exclude: none-of)."""
    subset: str | None = None
    doc_id: str | None = None
    category: str | None = None
    unit_kind: str | None = None
    fragment_type: str | None = None
    labels: list[str] | str | None = None
    exclude_labels: list[str] | str | None = None
    min_annotators: int | None = None
    high_confidence: bool = False
    q: str | None = None
    sample_view: list[str] | str | None = None
    evidence_threshold: int | None = 1
    min_support: int | None = 1
    support_mode: str | None = "at_least"


    def without(self, label: str) -> "UnitFilter":
        excluded = name_list(self.exclude_labels)
        if label in excluded:
            return self
        return replace(self, exclude_labels=excluded + [label])

    @property
    def tier(self) -> int:
        level = int(self.min_support or 1)
        return level if level in (1, 2, 3) else 1

    @property
    def threshold(self) -> int:
        return int(self.evidence_threshold or 1)

    @property
    def mode(self) -> str:
        return self.support_mode or "at_least"

    @property
    def narrows_evidence(self) -> bool:
        """A label or support condition is in force."""
        return bool(self.tier > 1 or self.mode == "exact" or self.threshold > 1
                    or name_list(self.labels) or name_list(self.exclude_labels))

    @property
    def views(self) -> list[str] | None:
        """Known sample families asked for; None when no view was given at all."""
        asked = name_list(self.sample_view)
        return [v for v in asked if v in FAMILIES] if asked else None

    @property
    def only_fragments(self) -> bool:
        """Fragments alone can pass, and nothing asks for labels or annotators."""
        fragments = self.unit_kind == "fragment" or self.fragment_type or self.views == ["fragments"]
        return bool(fragments and not (self.narrows_evidence or self.needs_gate or self.min_annotators))

    @property
    def needs_gate(self) -> bool:
        if self.views is None:
            return self.narrows_evidence
        return bool({"single", "multi"} & set(self.views))


def _column_conditions(f: UnitFilter) -> list[Column]:
    equal = {"subset": f.subset, "doc_id": f.doc_id, "label_category": f.category,
             "unit_kind": f.unit_kind, "fragment_type": f.fragment_type}
    conditions = [F.col(c) == v for c, v in equal.items() if v]
    if f.min_annotators:
        conditions.append(F.col("annotator_count") >= int(f.min_annotators))
    if f.high_confidence:
        conditions.append((F.col("label_category") == "single_label")
                          & (F.col("annotator_count") >= 2))
    if f.q:
        conditions.append(contains_ci(F.col("unit_text"), f.q))
    return conditions


def gate(corpus: Corpus, f: UnitFilter) -> DataFrame:
    return support_gate(support_at(corpus.ladder, f.threshold), f.tier, f.mode)


def filter_units(corpus: Corpus, f: UnitFilter) -> DataFrame:
    """Rows of ``text_units`` that satisfy ``f``.

    Conditions on plain columns come first and reach the scan; a text to look for
    goes by the corpus's text index, if it has one. Labels are looked
    up in the unit's own label array (equal to a join with ``unit_labels``). The
    ladder of votes is read only when a condition depends on it.
    """
    units = corpus.text_units
    if f.q and corpus.text_index:
        units = corpus.text_index.narrowed(units, [f.q])
    units = units.where(reduce(lambda a, b: a & b, _column_conditions(f), F.lit(True)))
    wanted, unwanted = name_list(f.labels), name_list(f.exclude_labels)
    if wanted:
        units = units.where(F.arrays_overlap("labels", F.array(*map(F.lit, wanted))))
    if unwanted:
        units = units.where(~F.arrays_overlap("labels", F.array(*map(F.lit, unwanted))))

    views = f.views
    category, kind = F.col("label_category"), F.col("unit_kind")
    # Families that carry no labels cannot meet a label or support condition.
    plain = F.lit(not f.narrows_evidence)
    family = {
        "single": (kind == "sentence") & (category == "single_label"),
        "multi": (kind == "sentence") & (category == "multi_label"),
        "null": (kind == "sentence") & (category == "unlabeled") & plain,
        "fragments": (kind == "fragment") & plain,
    }
    if views is None:
        if not f.narrows_evidence:
            return units
        defined = units.where(category.isin("single_label", "multi_label"))
        return defined.join(gate(corpus, f), ["doc_id", "unit_id"], "left_semi")
    if not views:
        return units
    if not f.needs_gate:
        return units.where(reduce(lambda a, b: a | b, [family[v] for v in views]))
    gated = reduce(lambda a, b: a | b, [family[v] for v in views if v in ("single", "multi")])
    passed = units.where(gated).join(gate(corpus, f), ["doc_id", "unit_id"], "left_semi")
    rest = [family[v] for v in dict.fromkeys(views) if v in ("null", "fragments")]
    if not rest or f.narrows_evidence:
        return passed
    return passed.unionByName(units.where(reduce(lambda a, b: a | b, rest)))


def underdefined(corpus: Corpus, f: UnitFilter) -> DataFrame:
    """Labelled sentences that fail the support condition of ``f``."""
    defined = corpus.text_units.where(F.col("label_category").isin("single_label", "multi_label"))
    return defined.join(gate(corpus, f), ["doc_id", "unit_id"], "left_anti")


def filter_spans(annotations: DataFrame, doc_id: str | None = None, ranumb: str | None = None,
                 label: str | None = None, labels=None, exclude_labels=None,
                 status: str | None = None) -> DataFrame:
    equal = {"doc_id": doc_id, "ranumb": None if ranumb == "all" else ranumb,
             "status": status, "label": label}
    for column, value in equal.items():
        if value:
            annotations = annotations.where(F.col(column) == value)
    if name_list(labels):
        annotations = annotations.where(F.col("label").isin(*name_list(labels)))
    if name_list(exclude_labels):
        annotations = annotations.where(~F.col("label").isin(*name_list(exclude_labels)))
    return annotations


def filter_documents(documents: DataFrame, subset: str | None = None,
                     q: str | None = None) -> DataFrame:
    """``q`` is matched against link and id; its wildcards are live."""
    if subset:
        documents = documents.where(F.col("subset") == subset)
    if q:
        documents = documents.where(like_ci(F.col("link"), q) | like_ci(F.col("doc_id"), q))
    return documents


def of_annotators(annotations: DataFrame, ranumbs: str | None) -> DataFrame:
    """Restrict to a comma list; given but empty means nobody."""
    if ranumbs is None:
        return annotations
    names = name_list(ranumbs)
    return annotations.where(F.col("ranumb").isin(*names) if names else F.lit(False))
