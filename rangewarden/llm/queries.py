"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from rangewarden.llm.embedding_dedup import OP3_SQL, op3
from rangewarden.llm.exact_dedup import OP5_SQL, op5
from rangewarden.llm.html_text import op2
from rangewarden.llm.language_id import op10
from rangewarden.llm.packing import op1
from rangewarden.llm.piece_codec import op6
from rangewarden.llm.simhash import op4
from rangewarden.llm.suffix_dedup import op9
from rangewarden.llm.token_files import op8
from rangewarden.llm.toxicity import op7


def queries() -> dict:
    return {
        "op1_pack_by_cost": op1,
        "op2_dom_trees": op2,
        "op3_multi_index": op3,
        "op4_simhash_tiles": op4,
        "op5_content_sort": op5,
        "op6_sentencepiece": op6,
        "op7_ordinal_severity": op7,
        "op8_token_files": op8,
        "op9_prefix_doubling": op9,
        "op10_hyperdimensional": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_multi_index": OP3_SQL, "op5_content_sort": OP5_SQL}
