"""SQL functions over the views of a corpus, for ``spark.sql``.

Scalar: ``label_token(label)``, ``tier(k, pool)``. Tables: ``support(threshold)`` with the
agreement of every unit and label, and ``units(q, min_support)`` with the labelled
units that hold a text (null: any) and whose best label reaches a tier.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanloom.plans.corpus import Corpus
from spanloom.schema import LABEL_TOKENS


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_KNOWN = ", ".join(_text(x) for kv in LABEL_TOKENS.items() for x in kv)
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

FUNCTIONS = {
    "label_token(label STRING) RETURNS STRING": f"""
        coalesce(try_element_at(map({_KNOWN}), label), upper(regexp_replace(
          replace(replace(replace(label, '/', ' OR '), '-', '_'), ' ', '_'), '[^\\\\p{{L}}\\\\p{{N}}_]', '')))""",
    "tier(k BIGINT, pool BIGINT) RETURNS INT":
        "CASE WHEN k = pool THEN 3 WHEN k * 2 >= pool THEN 2 ELSE 1 END",
    "support(threshold INT) RETURNS TABLE(doc_id STRING, unit_id STRING, label STRING, k BIGINT, pool BIGINT, stars INT)": """
        SELECT doc_id, unit_id, label, count(*), pool, tier(count(*), pool)
        FROM ladder LATERAL VIEW explode(steps) s AS step WHERE step >= threshold
        GROUP BY doc_id, unit_id, label, pool""",
    "units(q STRING, min_support INT) RETURNS TABLE(doc_id STRING, position INT, unit_id STRING, unit_text STRING, "
    "label_category STRING, labels ARRAY<STRING>, stars INT)": f"""
        SELECT u.doc_id, u.position, u.unit_id, u.unit_text, u.label_category, u.labels, b.stars
        FROM text_units u JOIN (SELECT doc_id, unit_id, max(stars) AS stars FROM support(1)
                                GROUP BY doc_id, unit_id) b ON u.doc_id = b.doc_id AND u.unit_id = b.unit_id
        WHERE b.stars >= min_support AND (q IS NULL OR contains({_FOLD.format('u.unit_text')}, {_FOLD.format('q')}))""",
}


def register(spark: SparkSession, corpus: Corpus) -> None:
    """Views of the corpus's tables, and the functions over them, in this session."""
    corpus.register()
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
