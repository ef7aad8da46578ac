"""Queries over archives that Spark makes of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.plans.registry import query, table
from inkmill.sources import archives
from inkmill.sources.stages import shared_folder


def catalog_archives(s: SparkSession, d: str) -> str:
    """A folder of archives with a record for each part: read as often as it is large, its brand as its rights; some lack either."""
    parts = table(s, d, "part")
    downloads = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit('  <pgterms:downloads rdf:datatype="integer">'), F.col("p_size").cast("string"), F.lit("</pgterms:downloads>\n"))).otherwise("")
    rights = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("  <dcterms:rights>"), "p_brand", F.lit("</dcterms:rights>\n"))).otherwise("")
    rdf = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF>\n'), downloads, rights, F.lit("</rdf:RDF>\n"))
    name = F.format_string("cache/epub/%d/pg%d.rdf", "p_partkey", "p_partkey")
    path = f"{shared_folder(s)}/inkmill-archives-{uuid.uuid4().hex}"
    archives.write_members(parts.select(name.alias("name"), rdf.alias("content")).repartition("name"), path)
    return path


@query("q_catalog_archives", "SELECT p_partkey::VARCHAR AS book_id, CASE WHEN p_partkey % 7 <> 0 THEN p_size ELSE 0 END::BIGINT AS downloads, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END AS rights FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def q_catalog_archives(s: SparkSession, d: str) -> DataFrame:
    """Records of the parts that were ever ordered by fifty, out of archives of all parts."""
    wanted = table(s, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("book_id"))
    return archives.catalog_records(s, catalog_archives(s, d), wanted)
