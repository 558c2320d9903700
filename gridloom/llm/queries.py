"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, fingerprints, lines, minhash, mixing, quality, repeats, sharding, warc

QUERIES = {"op1_minhash": minhash.op1, "op2_lines": lines.op2, "op3_decontamination": decontamination.op3, "op4_quality": quality.op4, "op5_warc": warc.op5, "op6_sharding": sharding.op6, "op7_repeats": repeats.op7, "op8_fingerprints": fingerprints.op8, "op9_mixing": mixing.op9, "op10_chat_formatting": chat.op10}
ORACLES = {"op1_minhash": minhash.ORACLE, "op2_lines": lines.ORACLE, "op5_warc": warc.ORACLE, "op3_decontamination": decontamination.ORACLE, "op10_chat_formatting": chat.ORACLE}
