"""The queries of this package by name, and their SQL where SQL can say it."""

from __future__ import annotations

from keepset.llm import chosen_path, collocations, decontamination, html, lines, manifest, merkle, packing, quality, sharding, substrings, toxicity, urls

QUERIES = {
    "op1_packing": packing.packed_documents,
    "op2_toxicity": toxicity.toxicity_scores,
    "op3_quality": quality.quality_scores,
    "op4_html_text": html.page_texts,
    "op5_line_dedup": lines.document_lines,
    "op6_sharding": sharding.document_shards,
    "op7_fingerprints": merkle.document_fingerprints,
    "op8_near_duplicates": chosen_path.near_duplicate_documents,
    "op9_url_filter": urls.url_verdicts,
    "op10_decontamination": decontamination.contaminated_documents,
    "op11_manifest": manifest.document_manifest,
    "op12_collocations": collocations.document_collocations,
    "op13_substring_dedup": substrings.deduplicated_documents,
}

ORACLES = {
    "op6_sharding": sharding.oracle(),
    "op11_manifest": manifest.oracle(),
    "op12_collocations": collocations.oracle(),
}
