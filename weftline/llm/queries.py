"""The registered queries of this package and their SQL, by name."""

from __future__ import annotations

from weftline.llm import decontaminate, fillmiddle, htmltext, licenses, linededup, ngramjoin, packing, quality, simhash, suffixdedup, toxicity, urlfilter, whitening

QUERIES = {
    "op1_url_filters": urlfilter.query,
    "op2_html_extraction": htmltext.query,
    "op3_packing": packing.query,
    "op4_line_dedup": linededup.query,
    "op5_license_scans": licenses.query,
    "op6_suffix_array_dedup": suffixdedup.query,
    "op7_toxicity": toxicity.query,
    "op8_quality_rules": quality.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_benchmark_decontamination": decontaminate.query,
    "op11_ngram_jaccard_join": ngramjoin.query,
    "op12_embedding_whitening": whitening.query,
    "op13_fill_in_middle": fillmiddle.query,
}
ORACLES = {
    "op4_line_dedup": linededup.ORACLE_SQL,
    "op5_license_scans": licenses.ORACLE_SQL,
    "op8_quality_rules": quality.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op13_fill_in_middle": fillmiddle.ORACLE_SQL,
}
