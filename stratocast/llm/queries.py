"""The operators' queries over the given tables, and reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratocast.llm.bpe import op4_bpe
from stratocast.llm.chat import OP1_SQL, op1_chat
from stratocast.llm.collocations import OP13_SQL, op13_collocations
from stratocast.llm.decontamination import op10_decontamination
from stratocast.llm.doubling import op6_substring_dedup
from stratocast.llm.extraction import op9_extraction
from stratocast.llm.quality import op7_quality
from stratocast.llm.ranked import OP11_SQL, op11_ranked
from stratocast.llm.rank_tree import op12_rank_tree
from stratocast.llm.sharding import op8_sharding
from stratocast.llm.simhash import op3_simhash
from stratocast.llm.suffixes import op5_suffix_dedup
from stratocast.llm.token_files import op2_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_token_files": op2_token_files,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_extraction": op9_extraction,
    "op10_decontamination": op10_decontamination,
    "op11_ranked": op11_ranked,
    "op12_rank_tree": op12_rank_tree,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op1_chat": OP1_SQL, "op11_ranked": OP11_SQL, "op13_collocations": OP13_SQL}
