"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op11_tokenizer_alignment
from .bpe import op13_bpe_codec
from .embedding_dedup import OP3_SQL, op3_embedding_near_dedup
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .line_dedup import OP4_SQL, op4_line_dedup
from .minhash_dedup import OP10_SQL, op10_minhash_near_dedup
from .packing import op7_packing
from .pieces import op1_sentencepiece
from .quality import op8_quality_classifier
from .secrets import SECRET_BASE_SQL, op6_secret_scan, secret_base_spans
from .token_files import op5_token_files
from .toxicity import op2_toxicity
from .whitening import op12_embedding_whitening

_QUERIES = [op1_sentencepiece, op2_toxicity, op3_embedding_near_dedup, op4_line_dedup, op5_token_files, op6_secret_scan, op7_packing, op8_quality_classifier, op9_exact_dedup, op10_minhash_near_dedup, op11_tokenizer_alignment, op12_embedding_whitening, op13_bpe_codec, secret_base_spans]


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_near_dedup": OP3_SQL, "op10_minhash_near_dedup": OP10_SQL, "secret_base_spans": SECRET_BASE_SQL, "op4_line_dedup": OP4_SQL, "op9_exact_dedup": OP9_SQL}
