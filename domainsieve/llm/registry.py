"""Registered queries of the operators, and SQL with the same results where SQL can say it."""

from __future__ import annotations

from domainsieve.llm import (
    bpe, decontaminate, exact_dedup, langid, line_runs, minhash, packing, paragraphs, rp_forest, sharding,
    spelling, vector_codes, warc)


def queries():
    return {
        "op1_rp_forest": rp_forest.op1_rp_forest,
        "op2_packing": packing.op2_packing,
        "op3_minhash": minhash.op3_minhash,
        "op4_sharding": sharding.op4_sharding,
        "op5_substring_dedup": paragraphs.op5_substring_dedup,
        "op6_warc": warc.op6_warc,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_language_id": langid.op8_language_id,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_line_runs": line_runs.op10_line_runs,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_spelling": spelling.op12_spelling,
        "op13_decontaminate": decontaminate.op13_decontaminate,
    }


def oracles() -> dict[str, str]:
    return {"op6_warc": warc.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE,
            "op10_line_runs": line_runs.ORACLE, "op11_vector_codes": vector_codes.ORACLE,
            "op13_decontaminate": decontaminate.ORACLE}
