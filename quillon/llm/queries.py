"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, lattice, linefilter, packing, prefixtrie, secrets, simhash, suffixes, toxicity, transcripts, warc

#: Query name: module that has a function of that name and, maybe, its SQL in ORACLE.
MODULES = {
    "op1_warc_chunks": warc,
    "op2_line_cleaning": linefilter,
    "op3_lattice_lm": lattice,
    "op4_decontamination": decontaminate,
    "op5_suffix_dedup": suffixes,
    "op6_simhash": simhash,
    "op7_tree_bpe": bpe,
    "op8_bit_packing": packing,
    "op9_transcripts": transcripts,
    "op10_toxicity": toxicity,
    "op11_source_divergence": divergence,
    "op12_secret_scan": secrets,
    "op13_prefix_trie": prefixtrie,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE[name] for name, module in MODULES.items() if name in getattr(module, "ORACLE", {})}
