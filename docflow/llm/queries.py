"""The queries of this subpackage and, where SQL can express them, the same for DuckDB."""

from __future__ import annotations

from . import chat, decontaminate, manifest, minhash, quality, repair, warc
from .bpe import op6_byte_bpe
from .chat import op1_chat_format
from .decontaminate import op4_decontamination
from .html_text import op7_html_text
from .manifest import op13_merkle_manifest
from .minhash import op12_minhash
from .pii import op10_pii
from .quality import op9_quality_rules
from .repair import op11_conversation_repair
from .simhash import op3_simhash
from .spans import op8_sentence_spans
from .unigram import op5_token_counts
from .warc import op2_warc

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_warc, op3_simhash, op4_decontamination, op5_token_counts, op6_byte_bpe, op7_html_text, op8_sentence_spans, op9_quality_rules, op10_pii, op11_conversation_repair, op12_minhash, op13_merkle_manifest)}

ORACLES: dict[str, str] = {"op1_chat_format": chat.ORACLE, "op2_warc": warc.ORACLE, "op4_decontamination": decontaminate.ORACLE, "op9_quality_rules": quality.ORACLE, "op11_conversation_repair": repair.ORACLE, "op12_minhash": minhash.ORACLE, "op13_merkle_manifest": manifest.ORACLE}
