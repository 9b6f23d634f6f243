"""The operators' queries, and SQL where it can express them."""

from __future__ import annotations

from gateledger.llm.bpetree import op7_byte_bpe
from gateledger.llm.capfilters import op8_embedding_links
from gateledger.llm.dialogues import op13_conversation_repair
from gateledger.llm.disclosure import op11_disclosure
from gateledger.llm.licenses import op5_license_scan
from gateledger.llm.packing import op9_packing
from gateledger.llm.quality import op2_quality_rules
from gateledger.llm.sigtrees import op6_jaccard_join
from gateledger.llm.spelling import op12_spelling_variants
from gateledger.llm.suffixindex import op1_suffix_dedup
from gateledger.llm.tokencounts import op4_token_counts
from gateledger.llm.tokenfiles import op3_token_files
from gateledger.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_license_scan": op5_license_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_embedding_links": op8_embedding_links,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_disclosure": op11_disclosure,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {}
