"""The registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from signalbed.llm.bpe import op8_bpe
from signalbed.llm.collocations import OP11_SQL, op11_collocations
from signalbed.llm.decontaminate import OP10_SQL, op10_decontaminate
from signalbed.llm.lang_id import op1_language_id
from signalbed.llm.licenses import op6_license_scan
from signalbed.llm.minhash import OP7_SQL, op7_minhash
from signalbed.llm.mixing import OP13_SQL, op13_mixing
from signalbed.llm.pii import op9_pii
from signalbed.llm.quality import op3_quality
from signalbed.llm.search import OP12_SQL, op12_search
from signalbed.llm.substrings import OP4_SQL, op4_substrings
from signalbed.llm.toxicity import op5_toxicity
from signalbed.llm.vectors import OP2_SQL, op2_embedding_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality": op3_quality,
    "op4_substrings": op4_substrings,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_minhash": op7_minhash,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_search": op12_search,
    "op13_mixing": op13_mixing,
}
CHECKS: dict[str, str] = {
    "op2_embedding_dedup": OP2_SQL,
    "op4_substrings": OP4_SQL,
    "op7_minhash": OP7_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_search": OP12_SQL,
    "op13_mixing": OP13_SQL,
}
