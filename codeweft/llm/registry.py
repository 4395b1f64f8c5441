"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .conversations import op12_conversations
from .html_text import op3_html
from .lexical import OP13_SQL, op13_lexical
from .licenses import op5_licenses
from .lm import op7_lm
from .media import op4_media
from .mixing import op2_mixing
from .packing import op10_packing
from .quality import op6_quality
from .simhash import op8_simhash
from .token_counts import op11_token_counts
from .topk import OP1_SQL, op1_topk
from .toxicity import op9_toxicity

QUERIES = {
    "op1_topk": op1_topk,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_media": op4_media,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_lm": op7_lm,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_token_counts": op11_token_counts,
    "op12_conversations": op12_conversations,
    "op13_lexical": op13_lexical,
}

ORACLES: dict[str, str] = {"op1_topk": OP1_SQL, "op13_lexical": OP13_SQL}
