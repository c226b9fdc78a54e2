"""The queries of the training-data operators and their DuckDB SQL, by name."""

from __future__ import annotations

import functools

from stratum.llm.chat import OP10_SQL, op10_chat_format
from stratum.llm.common import modest_batches
from stratum.llm.decontaminate import op6_decontaminate
from stratum.llm.neardup import op8_near_duplicates
from stratum.llm.packing import op2_packing
from stratum.llm.quality import OP7_SQL, op7_quality_rules
from stratum.llm.suffix import op1_suffix_dedup
from stratum.llm.tokenstore import op9_token_store
from stratum.llm.toxicity import op4_toxicity
from stratum.llm.transducer import op5_token_counts
from stratum.llm.warc import OP3_SQL, op3_warc



def _with_modest_batches(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        modest_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op4_toxicity": op4_toxicity,
    "op1_suffix_dedup": op1_suffix_dedup,
    "op8_near_duplicates": op8_near_duplicates,
    "op6_decontaminate": op6_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op9_token_store": op9_token_store,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op7_quality_rules": op7_quality_rules,
    "op10_chat_format": op10_chat_format,
}
QUERIES = {name: _with_modest_batches(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op7_quality_rules": OP7_SQL, "op10_chat_format": OP10_SQL}
