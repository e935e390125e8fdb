"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import sql
from .bpe import op2_bpe
from .embeddings import op10_embeddings
from .hard_negatives import op11_hard_negatives
from .html_extract import op12_html
from .mixing import op4_mixing
from .near_dedup import op7_near_dedup
from .quality_model import op6_quality_model
from .quality_rules import op8_quality_rules
from .substrings import op3_substrings
from .token_files import op5_token_files
from .toxicity import op1_toxicity
from .url_filter import op9_url_filter
from .vector_codes import op13_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_bpe,
        op3_substrings,
        op4_mixing,
        op5_token_files,
        op6_quality_model,
        op7_near_dedup,
        op8_quality_rules,
        op9_url_filter,
        op10_embeddings,
        op11_hard_negatives,
        op12_html,
        op13_vector_codes,
    )
}
SQL = {"op3_substrings": sql.OP3, "op7_near_dedup": sql.OP7, "op8_quality_rules": sql.OP8, "op9_url_filter": sql.OP9, "op10_embeddings": sql.OP10, "op11_hard_negatives": sql.OP11, "op12_html": sql.OP12, "op13_vector_codes": sql.OP13}
