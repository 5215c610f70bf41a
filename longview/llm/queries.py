"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from .ball_tree import OP12_SQL, op12_hard_negatives
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .language_id import op2_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .matrix_join import OP11_SQL, op11_matrix_join
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import OP5_SQL, op5_mixing
from .near_dedup import op4_minhash_near_dedup
from .packing import op10_packing
from .pii import op7_pii
from .topk import OP9_SQL, op9_exact_topk
from .toxicity import op3_toxicity
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_packing": op10_packing,
    "op11_matrix_join": op11_matrix_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The others have no SQL: they learn (2, 3), hash at random (4), scan with validators (7) or tokenise (10).
SQL = {
    "op1_line_dedup": OP1_SQL,
    "op5_mixing": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_exact_topk": OP9_SQL,
    "op11_matrix_join": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
