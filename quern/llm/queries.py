"""The registered queries of the text operators, and their DuckDB SQL."""

from __future__ import annotations

from . import alignment, byte_bpe, decontaminate, exact_dedup, jaccard_join, language, lm_score, packing, private_data, quality, secrets, vector_codes, warc

QUERIES = {
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_warc": warc.op3_warc,
    "op4_language": language.op4_language,
    "op1_quality": quality.op1_quality,
    "op5_packing": packing.op5_packing,
    "op6_private_data": private_data.op6_private_data,
    "op7_secrets": secrets.op7_secrets,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_lm_score": lm_score.op9_lm_score,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {"op3_warc": warc.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL, "op10_jaccard_join": jaccard_join.ORACLE_SQL, "op11_vector_codes": vector_codes.ORACLE_SQL, "op12_decontaminate": decontaminate.ORACLE_SQL}
