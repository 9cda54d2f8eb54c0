"""Queries of the corpus operators over their whole tables, and SQL for those that SQL can express."""

from dialoom.llm import alignment, bpe, embeddings, factors, jaccard, lloyd, mixing, ngrams, quality, quotes, secrets, topk, urls

QUERIES = {
    "op1_mixing_sources": mixing.op1_mixing_sources,
    "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_quotation_linking": quotes.op4_quotation_linking,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_quality": quality.op6_quality,
    "op7_url_filters": urls.op7_url_filters,
    "op8_exact_top_k": topk.op8_exact_top_k,
    "op9_ngram_scores": ngrams.op9_ngram_scores,
    "op10_bpe": bpe.op10_bpe,
    "op11_centroid_clusters": lloyd.op11_centroid_clusters,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_substring_dedup": factors.op13_substring_dedup,
}
ORACLE_SQL = {
    "op1_mixing_sources": mixing.ORACLE,
    "op7_url_filters": urls.ORACLE,
    "op11_centroid_clusters": lloyd.ORACLE,
    "op13_substring_dedup": factors.ORACLE,
}
