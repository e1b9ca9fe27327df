"""The operators' queries and those SQL counterparts that SQL can express."""

from __future__ import annotations

from barloom.llm import clustering, discriminant, divergence, exact, langid, lines, packing, passages, perplexity, repair, simhash, transducer, urlrules

QUERIES = {
    "op1_language_id": langid.query,
    "op2_packing": packing.query,
    "op3_quality_rules": perplexity.query,
    "op4_token_files": repair.query,
    "op5_quality_classifier": discriminant.query,
    "op6_passages": passages.query,
    "op7_line_dedup": lines.query,
    "op8_exact_dedup": exact.query,
    "op9_sentencepiece": transducer.query,
    "op10_simhash": simhash.query,
    "op11_clusters": clustering.query,
    "op12_url_rules": urlrules.query,
    "op13_source_divergence": divergence.query,
}
ORACLES = {
    "op7_line_dedup": lines.SQL,
    "op8_exact_dedup": exact.SQL,
    "op11_clusters": clustering.SQL,
    "op13_source_divergence": divergence.SQL,
}
