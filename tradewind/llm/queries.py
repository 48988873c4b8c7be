"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tradewind.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from tradewind.llm.decontaminate import OP3_SQL, op3_decontaminate
from tradewind.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from tradewind.llm.html_extract import op1_html_extract
from tradewind.llm.license_scan import OP12_SQL, op12_license_scan
from tradewind.llm.merkle import OP11_SQL, op11_merkle_manifest
from tradewind.llm.mixing import OP8_SQL, op8_mix_sources
from tradewind.llm.ngram_join import OP4_SQL, op4_ngram_join
from tradewind.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from tradewind.llm.token_counts import op9_token_counts
from tradewind.llm.token_shards import op5_token_shards
from tradewind.llm.toxicity import op7_toxicity
from tradewind.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_ngram_join": op4_ngram_join,
    "op5_token_shards": op5_token_shards,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_mix_sources": op8_mix_sources,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_license_scan": op12_license_scan,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES = {
    "op2_substring_dedup": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_ngram_join": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op8_mix_sources": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
