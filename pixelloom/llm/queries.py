"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, hidden_markov, language_id, licenses, near_dedup, packing, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_warc": warc.op2,
    "op3_fingerprint": fingerprint.op3,
    "op4_packing": packing.op4,
    "op5_decontamination": decontaminate.op5,
    "op6_near_dedup": near_dedup.op6,
    "op7_chat_format": chat.op7,
    "op8_hidden_markov": hidden_markov.op8,
    "op9_license_scan": licenses.op9,
    "op10_language_id": language_id.op10,
}
ORACLES: dict[str, str] = {"op2_warc": warc.ORACLE2, "op5_decontamination": decontaminate.ORACLE5, "op7_chat_format": chat.ORACLE7, "op9_license_scan": licenses.ORACLE9}
