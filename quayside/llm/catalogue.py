"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from quayside.llm.chat_format import OP4_SQL, op4_chat_format
from quayside.llm.class_lm import op3_class_lm
from quayside.llm.collocations import OP13_SQL, op13_phrase_collocations
from quayside.llm.decontamination import OP9_SQL, op9_decontamination
from quayside.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from quayside.llm.jaccard_join import OP2_SQL, op2_jaccard_join
from quayside.llm.language_id import op5_language_id
from quayside.llm.packing import op6_packing
from quayside.llm.sharding import op8_sharding
from quayside.llm.substring_dedup import op1_substring_dedup
from quayside.llm.token_counts import op12_token_counts
from quayside.llm.url_filters import OP10_SQL, op10_url_filters
from quayside.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_class_lm": op3_class_lm,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_url_filters": op10_url_filters,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_token_counts": op12_token_counts,
    "op13_phrase_collocations": op13_phrase_collocations,
}
SQL = {
    "op2_jaccard_join": OP2_SQL,
    "op4_chat_format": OP4_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_url_filters": OP10_SQL,
    "op13_phrase_collocations": OP13_SQL,
}
