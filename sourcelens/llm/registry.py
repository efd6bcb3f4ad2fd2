"""Queries of this subpackage by name, and the SQL that says the same where SQL can."""

from sourcelens.llm.benchmark import OP9_SQL, op9_decontamination
from sourcelens.llm.conversations import op13_conversations
from sourcelens.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from sourcelens.llm.licenses import op8_licenses
from sourcelens.llm.lines import op2_lines
from sourcelens.llm.packing import op10_packing
from sourcelens.llm.resampling import op3_resampling
from sourcelens.llm.simhash import op5_simhash
from sourcelens.llm.suffix import op1_suffix_array
from sourcelens.llm.token_files import op4_token_files
from sourcelens.llm.token_counts import op12_token_counts
from sourcelens.llm.toxicity import op6_toxicity
from sourcelens.llm.vectors import OP7_SQL, op7_embeddings

QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_lines": op2_lines,
    "op3_resampling": op3_resampling,
    "op4_token_files": op4_token_files,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_embeddings": op7_embeddings,
    "op8_licenses": op8_licenses,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_conversations": op13_conversations,
}
ORACLE_SQL: dict[str, str] = {
    "op7_embeddings": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
