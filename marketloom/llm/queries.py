"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import collocations, conversations, decontamination, fingerprints, language, line_dedup, near_duplicates, packing, phrases, pii, substrings, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.op1_token_files,
    "op2_byte_network_language": language.op2_byte_network_language,
    "op3_toxic_chain": toxicity.op3_toxic_chain,
    "op4_tensored_minhash": near_duplicates.op4_tensored_minhash,
    "op5_suffix_array_dedup": substrings.op5_suffix_array_dedup,
    "op8_phrase_automata": phrases.op8_phrase_automata,
    "op6_merkle_fingerprints": fingerprints.op6_merkle_fingerprints,
    "op9_fm_decontamination": decontamination.op9_fm_decontamination,
    "op10_pii_spans": pii.op10_pii_spans,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op11_hirschberg_repair": conversations.op11_hirschberg_repair,
    "op12_collocations": collocations.op12_collocations,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

ORACLES: dict[str, str] = {"op12_collocations": collocations.OP12_SQL, "op13_line_dedup": line_dedup.OP13_SQL}
