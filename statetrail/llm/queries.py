"""The registered queries of this subpackage, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from .byte_pairs import op1_byte_pairs
from .decontamination import OP6_SQL, op6_decontamination
from .importance import OP12_SQL, op12_importance_resampling
from .language_id import op13_language_id
from .line_dedup import op10_line_dedup
from .ngram_jaccard import op2_ngram_jaccard
from .packing import op4_packed_ids
from .private_spans import op9_private_data
from .quality_ledger import OP5_SQL, op5_quality_rules
from .secret_scan import op7_secret_scan
from .token_counts import op8_token_counts
from .toxicity import op3_toxicity
from .whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (
    op1_byte_pairs, op2_ngram_jaccard, op3_toxicity, op4_packed_ids, op5_quality_rules,
    op6_decontamination, op7_secret_scan, op8_token_counts, op9_private_data, op10_line_dedup,
    op11_embedding_whitening, op12_importance_resampling, op13_language_id,
)}

#: Sets of shingles, learned models, vocabularies and edit distances are beyond SQL; the tests
#: compare those operators with plain versions.
ORACLE_SQL = {"op5_quality_rules": OP5_SQL, "op6_decontamination": OP6_SQL,
              "op12_importance_resampling": OP12_SQL}
