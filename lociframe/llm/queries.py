"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import kd_clusters, merkle, mixing, packing, pii, quality, signature_join, simhash, spotsigs, suffix_dedup, training_order, urls, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_training_order": training_order.op2_training_order,
    "op3_url_filters": urls.op3_url_filters,
    "op4_packing": packing.op4_packing,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_mixing_sources": mixing.op6_mixing_sources,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_spotsigs": spotsigs.op8_spotsigs,
    "op9_warc": warc.op9_warc,
    "op10_pii": pii.op10_pii,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_signature_join": signature_join.op12_signature_join,
    "op13_kd_clusters": kd_clusters.op13_kd_clusters,
}

ORACLE_SQL = {
    "op3_url_filters": urls.OP3_SQL,
    "op6_mixing_sources": mixing.OP6_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_signature_join": signature_join.OP12_SQL,
    "op13_kd_clusters": kd_clusters.OP13_SQL,
}
