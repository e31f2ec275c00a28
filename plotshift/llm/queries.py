"""Registered queries of this package: each applies one operator to the whole of its table."""

from __future__ import annotations

from plotshift.llm import alignment, chat, decontam, hmm, langid, minhash, packing, pii, prefix_trie, quality, secret_scan, sharding, substring
from plotshift.llm.frames import table
from plotshift.llm.queries_sql import SQL  # noqa: F401


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_hmm_score": lambda s, d: hmm.report(table(s, d, "documents")),
    "op2_personal_data": lambda s, d: pii.report(table(s, d, "documents")),
    "op3_crf_language": lambda s, d: langid.report(table(s, d, "documents")),
    "op4_bottom_k_near_dedup": lambda s, d: minhash.report(table(s, d, "documents")),
    "op5_secret_layers": lambda s, d: secret_scan.report(table(s, d, "documents")),
    "op6_quality_rules": lambda s, d: quality.report(table(s, d, "documents")),
    "op7_chat_parts": lambda s, d: chat.report(table(s, d, "conversations")),
    "op8_positional_index": lambda s, d: decontam.report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op9_best_two_fit": lambda s, d: packing.report(table(s, d, "documents")),
    "op10_block_anchors": lambda s, d: substring.report(table(s, d, "documents")),
    "op11_external_shuffle": lambda s, d: sharding.report(table(s, d, "documents")),
    "op12_galloping_alignment": lambda s, d: alignment.report(table(s, d, "documents")),
    "op13_burst_trie": lambda s, d: prefix_trie.report(table(s, d, "conversations")),
    "pipeline": pipeline,
}
