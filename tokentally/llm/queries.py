"""Registered queries of the llm operators."""

from __future__ import annotations

from tokentally.llm.op1_html import op1_html
from tokentally.llm.op10_quotes import op10_quotes
from tokentally.llm.op11_divergence import op11_divergence
from tokentally.llm.op12_trie import op12_trie
from tokentally.llm.op13_warc import op13_warc
from tokentally.llm.op2_toxicity import op2_toxicity
from tokentally.llm.op3_lm import op3_lm
from tokentally.llm.op4_jaccard import op4_jaccard
from tokentally.llm.op5_mix import op5_mix
from tokentally.llm.op6_perplexity import op6_perplexity
from tokentally.llm.op7_decontaminate import op7_decontaminate
from tokentally.llm.op8_licenses import op8_licenses
from tokentally.llm.op9_token_file import op9_token_file
from tokentally.llm.sources import shipped

QUERIES = {
    "op1_html": op1_html,
    "op2_toxicity": op2_toxicity,
    "op3_lm": op3_lm,
    "op4_jaccard": op4_jaccard,
    "op5_mix": op5_mix,
    "op6_perplexity": op6_perplexity,
    "op7_decontaminate": op7_decontaminate,
    "op8_licenses": op8_licenses,
    "op9_token_file": op9_token_file,
    "op10_quotes": op10_quotes,
    "op11_divergence": op11_divergence,
    "op12_trie": op12_trie,
    "op13_warc": op13_warc,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
