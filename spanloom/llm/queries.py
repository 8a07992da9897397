"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import conversations, decontaminate, fillmiddle, fingerprint, htmltext, langid, licenses, mixing, neardup, packing, secret_scan, sstable, wordpiece


def queries() -> dict:
    return {
        "op1_token_shards": sstable.op1_token_shards,
        "op2_token_counts": wordpiece.op2_token_counts,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_language": langid.op4_language,
        "op5_main_text": htmltext.op5_main_text,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_near_duplicates": neardup.op7_near_duplicates,
        "op8_fingerprint": fingerprint.op8_fingerprint,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_licenses": licenses.op10_licenses,
        "op11_best_fit_packing": packing.op11_best_fit_packing,
        "op12_fill_in_middle": fillmiddle.op12_fill_in_middle,
        "op13_prefix_trie": conversations.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_scan": secret_scan.SQL,
        "op9_decontaminate": decontaminate.SQL,
        "op12_fill_in_middle": fillmiddle.SQL,
        "op13_prefix_trie": conversations.SQL,
    }
