"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import chat, exact_dedup, licenses
from tessera.llm.byte_bpe import op7_byte_bpe
from tessera.llm.chat import op10_chat_formatting
from tessera.llm.exact_dedup import op8_exact_dedup
from tessera.llm.html_text import op1_html_extraction
from tessera.llm.licenses import op6_license_scan
from tessera.llm.ngram_join import op5_ngram_join
from tessera.llm.packing import op4_packing
from tessera.llm.quality import op2_quality
from tessera.llm.tiff import op9_media_tiff
from tessera.llm.toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_quality, op3_toxicity, op4_packing, op5_ngram_join, op6_license_scan, op7_byte_bpe, op8_exact_dedup, op9_media_tiff, op10_chat_formatting)
}
ORACLE = {"op6_license_scan": licenses.SQL, "op8_exact_dedup": exact_dedup.SQL, "op10_chat_formatting": chat.SQL}
