"""The registered queries of this package and their SQL."""

from __future__ import annotations

from quarryline.llm.bloom_lm import op1_lm_score
from quarryline.llm import bit_sliced, chat_format, decontaminate, spelling_variants
from quarryline.llm.bit_sliced import op12_bit_sliced
from quarryline.llm.chat_format import op5_chat_format
from quarryline.llm.decontaminate import op7_decontaminate
from quarryline.llm.line_crf import op6_line_crf
from quarryline.llm.mixing import op10_mixing
from quarryline.llm.quality_rules import op4_quality_rules
from quarryline.llm.simhash import op9_simhash
from quarryline.llm.site_template import op11_site_template
from quarryline.llm.spelling_variants import op13_spelling_variants
from quarryline.llm.token_counts import op8_token_counts
from quarryline.llm.token_files import op3_token_files
from quarryline.llm.warc import op2_warc

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_warc": op2_warc,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_format": op5_chat_format,
    "op6_line_crf": op6_line_crf,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_site_template": op11_site_template,
    "op12_bit_sliced": op12_bit_sliced,
    "op13_spelling_variants": op13_spelling_variants,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": chat_format.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op12_bit_sliced": bit_sliced.ORACLE,
    "op13_spelling_variants": spelling_variants.ORACLE,
}
