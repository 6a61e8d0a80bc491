"""Queries of the training-data operators; each is tested against brute force, an exact round trip or held-out rows."""

from __future__ import annotations

import corpus_pipeline
from canopy.llm.bpe import op2_bpe_roundtrip
from canopy.llm.media import op3_iso_media
from canopy.llm.packing import op6_cost_balanced_packing
from canopy.llm.pii import op13_pii_spans
from canopy.llm.quality import op5_quality_cnn
from canopy.llm.repair import op12_conversation_repair
from canopy.llm.rollup import op7_token_rollup
from canopy.llm.simhash import op1_simhash_groups
from canopy.llm.sketch import op4_scaled_sketch
from canopy.llm.spelling import op11_spelling_variants
from canopy.llm.toxicity import op10_toxicity_bigru
from canopy.llm.urls import op9_url_association_rules
from canopy.llm.wavelet import op8_wavelet_shards

QUERIES = {
    "op1_simhash_groups": op1_simhash_groups,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_iso_media": op3_iso_media,
    "op4_scaled_sketch": op4_scaled_sketch,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_cost_balanced_packing": op6_cost_balanced_packing,
    "op7_token_rollup": op7_token_rollup,
    "op8_wavelet_shards": op8_wavelet_shards,
    "op9_url_association_rules": op9_url_association_rules,
    "op10_toxicity_bigru": op10_toxicity_bigru,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_pii_spans": op13_pii_spans,
    "pipeline": corpus_pipeline.run,
}

#: None of them can be expressed in SQL: byte-level BPE, networks, containers, sketches of chained hashes, rule mining.
ORACLE_SQL: dict[str, str] = {}
