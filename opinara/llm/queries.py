"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from opinara.llm import byte_bpe, chat_format, collocations, dual_tree_lloyd, language_id, minhash_dedup, order_minhash, packing, permutation_ann, quality_qda, substring_dedup, token_counts, warc

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_counts,
        warc.op2_warc,
        order_minhash.op3_order_minhash,
        chat_format.op4_chat_format,
        byte_bpe.op5_byte_bpe,
        permutation_ann.op6_permutation_ann,
        substring_dedup.op7_substring_dedup,
        language_id.op8_language_id,
        minhash_dedup.op9_minhash_dedup,
        packing.op10_packing,
        dual_tree_lloyd.op11_dual_tree_lloyd,
        collocations.op12_collocations,
        quality_qda.op13_quality_qda,
    )
}

ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op9_minhash_dedup": minhash_dedup.OP9_SQL,
    "op11_dual_tree_lloyd": dual_tree_lloyd.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
