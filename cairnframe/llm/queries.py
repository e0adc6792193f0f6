"""The queries of this subpackage over the tables of a folder, and the SQL for their rows."""

from __future__ import annotations

from . import ann, collocations, language_model, license_scan, mixing, neardup, packing, quality, resampling, secrets, sharding, toxicity, warc
from .common import table

QUERIES: dict = {
    "op2_license_scans": lambda spark, d: license_scan.query(table(spark, d, "documents")),
    "op4_sharding": lambda spark, d: sharding.query(table(spark, d, "documents")),
    "op5_warc": lambda spark, d: warc.query(table(spark, d, "pages")),
    "op1_nearest_neighbours": lambda spark, d: ann.query(table(spark, d, "embeddings")),
    "op9_minhash_near_dedup": lambda spark, d: neardup.query(table(spark, d, "documents")),
    "op7_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_secret_scans": lambda spark, d: secrets.query(table(spark, d, "documents")),
    "op8_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op3_packing": lambda spark, d: packing.query(table(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: quality.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op11_importance_resampling": resampling.run,
    "op12_collocations": collocations.run,
    "op13_language_model": language_model.run,
}
ORACLE_SQL: dict[str, str] = {
    "op2_license_scans": license_scan.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op6_secret_scans": secrets.ORACLE_SQL,
    "op11_importance_resampling": resampling.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
}
