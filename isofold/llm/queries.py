"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, language, lattice, licenses, lines, mixing, permutation, phrases, pseudonyms, simhash, substring, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_zstd": warc.op1_warc_zstd,
    "op2_simhash_vptree": simhash.op2_simhash_vptree,
    "op3_substring_superkmer": substring.op3_substring_superkmer,
    "op4_pii_feistel": pseudonyms.op4_pii_feistel,
    "op5_permutation_index": permutation.op5_permutation_index,
    "op6_language_bayes": language.op6_language_bayes,
    "op7_mixing_blocks": mixing.op7_mixing_blocks,
    "op8_license_winnowing": licenses.op8_license_winnowing,
    "op9_decontamination_winnowing": decontamination.op9_decontamination_winnowing,
    "op10_lattice_likelihood": lattice.op10_lattice_likelihood,
    "op11_line_dedup": lines.op11_line_dedup,
    "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
    "op13_phrase_mining": phrases.op13_phrase_mining,
}

SQL: dict[str, str] = {
    "op1_warc_zstd": warc.SQL,
    "op3_substring_superkmer": substring.SQL,
    "op7_mixing_blocks": mixing.oracle(),
    "op9_decontamination_winnowing": decontamination.SQL,
    "op11_line_dedup": lines.SQL,
    "op13_phrase_mining": phrases.SQL,
}
