"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from linkveil.llm import decontaminate, langid, ordinal, packing, quality_rules, secrets, sharding, simhash, tokens, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_kd_shards": sharding.op2_kd_shards,
    "op3_ordinal_quality": ordinal.op3_ordinal_quality,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_orc_tokens": tokens.op5_orc_tokens,
    "op6_packing": packing.op6_packing,
    "op7_langid": langid.op7_langid,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_warc": warc.op10_warc,
}

ORACLE: dict[str, str] = {"op4_decontamination": decontaminate.ORACLE, "op8_secrets": secrets.ORACLE, "op10_warc": warc.ORACLE}
