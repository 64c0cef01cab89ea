"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from stmtgauge.llm.byte_bpe import op7_byte_bpe
from stmtgauge.llm.embedding_dedup import op1_embedding_dedup
from stmtgauge.llm.fill_middle import OP13_SQL, op13_fill_middle
from stmtgauge.llm.html_text import op11_html_text
from stmtgauge.llm.line_quality import op10_line_quality
from stmtgauge.llm.mixing import op2_mixing
from stmtgauge.llm.sharding import op4_sharding
from stmtgauge.llm.simhash import op9_simhash
from stmtgauge.llm.substring import op6_substring_dedup
from stmtgauge.llm.token_counts import op3_token_counts
from stmtgauge.llm.token_files import op5_token_files
from stmtgauge.llm.topk import OP8_SQL, op8_top_products
from stmtgauge.llm.vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_token_files": op5_token_files,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_top_products": op8_top_products,
    "op9_simhash": op9_simhash,
    "op10_line_quality": op10_line_quality,
    "op11_html_text": op11_html_text,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_middle": op13_fill_middle,
}
SQL: dict[str, str] = {"op8_top_products": OP8_SQL, "op12_vector_codes": OP12_SQL, "op13_fill_middle": OP13_SQL}
