"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galley.llm.chat import OP1_SQL, op1_prefix_tree
from galley.llm.jaccard import op6_jaccard_join
from galley.llm.lattice import op12_lattice_scores
from galley.llm.line_dedup import op3_line_dedup
from galley.llm.negatives import OP11_SQL, op11_hard_negatives
from galley.llm.packing import op7_best_fit_packing
from galley.llm.periodic import op13_periodic_runs
from galley.llm.piece_bpe import op10_sentencepiece
from galley.llm.quality import op2_quality
from galley.llm.span_dedup import op4_span_dedup
from galley.llm.vectors import OP5_SQL, OP9_SQL, op5_embedding_dedup, op9_max_score
from galley.llm.warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_tree": op1_prefix_tree,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_span_dedup": op4_span_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_warc": op8_warc,
    "op9_max_score": op9_max_score,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lattice_scores": op12_lattice_scores,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {"op1_prefix_tree": OP1_SQL, "op5_embedding_dedup": OP5_SQL, "op8_warc": OP8_SQL, "op9_max_score": OP9_SQL, "op11_hard_negatives": OP11_SQL}
