"""The queries of this package, and the SQL of those that SQL can express."""

from bitloom.llm import sql
from bitloom.llm.best_fit_packing import op4_best_fit_packing
from bitloom.llm.decontamination import op9_decontamination
from bitloom.llm.html_extraction import op3_html_extraction
from bitloom.llm.line_dedup import op2_line_dedup
from bitloom.llm.media_columns import op10_media_columns
from bitloom.llm.ngram_join import op6_ngram_jaccard_join
from bitloom.llm.personal_data import op5_personal_data
from bitloom.llm.secret_scan import op1_secret_scan
from bitloom.llm.substring_dedup import op8_substring_dedup
from bitloom.llm.toxicity import op7_toxicity

QUERIES: dict = {"op1_secret_scan": op1_secret_scan, "op2_line_dedup": op2_line_dedup, "op3_html_extraction": op3_html_extraction, "op4_best_fit_packing": op4_best_fit_packing, "op5_personal_data": op5_personal_data, "op6_ngram_jaccard_join": op6_ngram_jaccard_join, "op7_toxicity": op7_toxicity, "op8_substring_dedup": op8_substring_dedup, "op9_decontamination": op9_decontamination, "op10_media_columns": op10_media_columns}
ORACLES: dict = {"op8_substring_dedup": sql.OP8, "op9_decontamination": sql.OP9}
