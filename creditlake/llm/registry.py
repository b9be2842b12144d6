"""The queries opN_<name>, and SQL for those that SQL can express."""

from creditlake.llm import op01_chat, op02_bpe, op03_lines, op04_suffixes, op05_toxicity, op06_media, op07_ann, op08_jaccard, op09_warc, op10_packing, op11_runs, op12_substrings, op13_trie

QUERIES = {
    "op1_chat_formatting": op01_chat.op1_chat_formatting,
    "op2_bpe": op02_bpe.op2_bpe,
    "op3_line_dedup": op03_lines.op3_line_dedup,
    "op4_suffix_dedup": op04_suffixes.op4_suffix_dedup,
    "op5_toxicity": op05_toxicity.op5_toxicity,
    "op6_media": op06_media.op6_media,
    "op7_ann": op07_ann.op7_ann,
    "op8_ngram_jaccard": op08_jaccard.op8_ngram_jaccard,
    "op9_warc": op09_warc.op9_warc,
    "op10_packing": op10_packing.op10_packing,
    "op11_periodic_runs": op11_runs.op11_periodic_runs,
    "op12_substring_dedup": op12_substrings.op12_substring_dedup,
    "op13_prefix_trie": op13_trie.op13_prefix_trie,
}
SQL = {
    "op1_chat_formatting": op01_chat.SQL,
    "op3_line_dedup": op03_lines.SQL,
    "op9_warc": op09_warc.SQL,
    "op11_periodic_runs": op11_runs.SQL,
    "op12_substring_dedup": op12_substrings.SQL,
    "op13_prefix_trie": op13_trie.SQL,
}
