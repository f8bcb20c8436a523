"""Table schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
          "strings": T.ArrayType(T.StringType()), "longs": T.ArrayType(T.LongType())}


def table(required: str, nullable: str = "") -> T.StructType:
    """Schema from ``name`` or ``name:type`` words, string by default."""
    def fields(words: str, null: bool):
        for word in words.split():
            name, _, kind = word.partition(":")
            yield T.StructField(name, _TYPES[kind or "string"], null)
    return T.StructType([*fields(required, False), *fields(nullable, True)])


DOCUMENTS = table(
    "doc_id subset num:int html_path",
    "title link is_homepage textmatch_p textmatch_s textmatch_pp link_match crawl_path")
ANNOTATIONS = table(
    "annotation_id doc_id ranumb text label status src_row:int source_csv", "n_hits:long span_rep:int")
TEXT_UNITS = table(
    "unit_id doc_id subset position:int block_seq:int block_kind unit_text unit_kind "
    "label_category annotator_count:int source_annotation_count:int",
    "fragment_type alignment_types labels:strings annotators:strings")
UNIT_LABELS = table("unit_id label doc_id")
ALIGNMENT = table("unit_id annotation_id alignment_type doc_id label ranumb unit_kind")
AMBIGUOUS = table("doc_id span_rep:int unit_id position:int")
LADDER = table("unit_id doc_id label steps:longs pool:long")
PAGE_INDEX = table("doc_id doc_no:long n_units:long units_before:long n_spans:long spans_before:long")
MANIFEST = table("key value")

# --- fixed values -----------------------------------------------------------
SUBSETS = ("DB", "WS")
UNIT_KINDS = ("sentence", "fragment")
BLOCK_KINDS = ("prose", "heading", "list")
FRAGMENT_TYPES = ("phone", "email", "url", "nav", "button", "copyright", "heading",
                  "list_item", "lead_in", "short", "other")
LABEL_CATEGORIES = ("single_label", "multi_label", "unlabeled", "not-eligible")
STATUSES = ("aligned", "unmatched", "ambiguous")
IN_SENTENCE = "annotation_in_sentence"
IN_PARAGRAPH = "sentence_in_annotation_paragraph"
OVERLAP = "partial_overlap"
ALIGNMENT_TYPES = (IN_SENTENCE, IN_PARAGRAPH, OVERLAP)

LABEL_TOKENS = {
    "Categories of Personal Information Collected": "CATEGORIES_OF_PERSONAL_INFORMATION_COLLECTED",
    "Categories of Personal Information Shared / Disclosed": "CATEGORIES_OF_PERSONAL_INFORMATION_SHARED_OR_DISCLOSED",
    "Categories of Personal Information Sold": "CATEGORIES_OF_PERSONAL_INFORMATION_SOLD",
    "Description of Right to Correct Information": "DESCRIPTION_OF_RIGHT_TO_CORRECT_INFORMATION",
    "Description of Right to Delete": "DESCRIPTION_OF_RIGHT_TO_DELETE",
    "Description of Right to Know PI Collected": "DESCRIPTION_OF_RIGHT_TO_KNOW_PI_COLLECTED",
    "Description of Right to Know PI sold / shared": "DESCRIPTION_OF_RIGHT_TO_KNOW_PI_SOLD_OR_SHARED",
    "Description of Right to Limit use of PI": "DESCRIPTION_OF_RIGHT_TO_LIMIT_USE_OF_PI",
    "Description of Right to Non-discrimination on exercising rights": "DESCRIPTION_OF_RIGHT_TO_NON_DISCRIMINATION",
    "Description of Right to Opt-out of sale of PI": "DESCRIPTION_OF_RIGHT_TO_OPT_OUT_OF_SALE_OF_PI",
    "Methods to exercise rights": "METHODS_TO_EXERCISE_RIGHTS",
    "Others": "OTHERS",
    "Updated Privacy Policy": "UPDATED_PRIVACY_POLICY",
}
LABELS = tuple(LABEL_TOKENS)

UNIT_FIELDS = (
    "id", "doc_id", "group", "text", "label", "label_name",
    "subset", "position", "unit_kind", "fragment_type", "label_category",
    "verbatim_labels", "annotator_count", "annotators",
    "source_annotation_count", "alignment_types",
)
EXTRA_FIELDS = ("support_stars", "support_evidence", "split")
DEFAULT_FIELDS = ("id", "doc_id", "text", "label", "label_name", "split")
# --- end of fixed values ----------------------------------------------------
