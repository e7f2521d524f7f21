"""The queries of the corpus operators, and their SQL where SQL can express them on whole tables."""

from trackloom.llm.bpe_automaton import op3_bpe_automaton
from trackloom.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from trackloom.llm.importance import op1_importance
from trackloom.llm.jaccard_join import op2_jaccard_join
from trackloom.llm.line_dedup import OP10_SQL, op10_line_dedup
from trackloom.llm.mixing import op5_mixing
from trackloom.llm.nearest import op9_nearest
from trackloom.llm.substring_dedup import op4_substring_dedup
from trackloom.llm.token_output import op8_token_output
from trackloom.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_importance": op1_importance,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_output": op8_token_output,
    "op9_nearest": op9_nearest,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL = {"op7_exact_dedup": OP7_SQL, "op10_line_dedup": OP10_SQL}
