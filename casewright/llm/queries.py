"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import alignment, bpe, exact_dedup, language, lm_scoring, packing, quality, simhash, spelling, suffix_dedup, token_output, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language": language.op3_language,
    "op4_token_output": token_output.op4_token_output,
    "op5_warc": warc.op5_warc,
    "op6_simhash": simhash.op6_simhash,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_bpe": bpe.op8_bpe,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality": quality.op10_quality,
    "op11_alignment": alignment.op11_alignment,
    "op12_spelling": spelling.op12_spelling,
    "op13_toxicity": toxicity.op13_toxicity,
}
SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op10_quality": quality.OP10_SQL,
}
