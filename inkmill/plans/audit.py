"""An audit of two versions of the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import audit
from inkmill.plans.registry import query, table
from inkmill.sources.stages import shared_folder


def altered(docs: DataFrame) -> DataFrame:
    """docs after a run that lost, changed and added some."""
    i = F.col("doc_id")
    kept = docs.where(i % 499 != 3).withColumn("text", F.when(i % 499 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return kept.unionByName(docs.where(i % 499 == 11).withColumn("doc_id", -i))


@query("q_run_audit", """SELECT doc_id, sha256(text) AS text_hash, 'old' AS side FROM documents WHERE doc_id % 499 IN (3, 7) UNION ALL SELECT doc_id, sha256(text || '!'), 'new' FROM documents WHERE doc_id % 499 = 7
UNION ALL SELECT -doc_id, sha256(text), 'new' FROM documents WHERE doc_id % 499 = 11""")
def q_run_audit(s: SparkSession, d: str) -> DataFrame:
    """The documents in which two versions of the table differ, out of the ranges alone that differ."""
    docs, at = table(s, d, "documents"), f"{shared_folder(s)}/inkmill-audit-{uuid.uuid4().hex}"
    audit.write_version(docs, f"{at}/old", "doc_id")
    audit.write_version(altered(docs), f"{at}/new", "doc_id")
    return audit.changes(s, f"{at}/old", f"{at}/new").select("doc_id", F.sha2("text", 256).alias("text_hash"), "side")
