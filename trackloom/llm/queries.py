"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_byte_owners
from .bpe_trie import op10_trie_bpe
from .lm_scoring import op9_gru_lm
from .packing import op2_nnls_packing
from .pii_crf import op3_pii_crf
from .quality_cascade import op5_quality_cascade
from .rans import op1_rans
from .rp_forest import op7_rp_forest
from .simhash import op6_simhash
from .sql import SQL
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op11_noisy_channel
from .vector_codes import op13_vector_codes
from .warc import op8_warc_derivatives


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rans": op1_rans,
        "op2_nnls_packing": op2_nnls_packing,
        "op3_pii_crf": op3_pii_crf,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality_cascade": op5_quality_cascade,
        "op6_simhash": op6_simhash,
        "op7_rp_forest": op7_rp_forest,
        "op8_warc_derivatives": op8_warc_derivatives,
        "op9_gru_lm": op9_gru_lm,
        "op10_trie_bpe": op10_trie_bpe,
        "op11_noisy_channel": op11_noisy_channel,
        "op12_byte_owners": op12_byte_owners,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
