"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.alignment import op12_alignment
from quillspark.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from quillspark.llm.fim import OP13_SQL, op13_fim
from quillspark.llm.huffman import op3_huffman
from quillspark.llm.lattice import op10_lattice
from quillspark.llm.media import op1_media
from quillspark.llm.mixing import OP6_SQL, op6_mix
from quillspark.llm.near_dedup import op9_near_dedup
from quillspark.llm.packing import op5_packing
from quillspark.llm.quality import op4_quality
from quillspark.llm.rollup import op2_rollup
from quillspark.llm.secrets import op7_secrets
from quillspark.llm.spotsigs import op11_spotsigs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_rollup": op2_rollup,
    "op3_huffman": op3_huffman,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_mix": op6_mix,
    "op7_secrets": op7_secrets,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_lattice": op10_lattice,
    "op11_spotsigs": op11_spotsigs,
    "op12_alignment": op12_alignment,
    "op13_fim": op13_fim,
}

ORACLES: dict[str, str] = {
    "op6_mix": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op13_fim": OP13_SQL,
}
