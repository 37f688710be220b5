"""The queries of the training-data operators and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

from . import crosstoken, decontam, fim, fingerprint, jaccard_join, langid, licenses, mixing, oracles, pii, quality, sharding, suffix_dedup, warc

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_personal_data": pii.op2,
    "op3_decontaminate": decontam.op3,
    "op6_source_mix": mixing.op6,
    "op10_quality_rank": quality.op10,
    "op9_license_scan": licenses.op9,
    "op4_fingerprint": fingerprint.op4,
    "op5_jaccard_join": jaccard_join.op5,
    "op7_suffix_dedup": suffix_dedup.op7,
    "op8_feistel_shards": sharding.op8,
    "op11_fill_in_middle": fim.op11,
    "op12_warc_chunks": warc.op12,
    "op13_token_alignment": crosstoken.op13,
}

ORACLES = {
    "op5_jaccard_join": oracles.OP5_SQL,
    "op7_suffix_dedup": oracles.OP7_SQL,
    "op8_feistel_shards": oracles.OP8_SQL,
    "op9_license_scan": oracles.OP9_SQL,
    "op3_decontaminate": decontam.OP3_SQL,
    "op6_source_mix": mixing.OP6_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op12_warc_chunks": warc.OP12_SQL,
}
