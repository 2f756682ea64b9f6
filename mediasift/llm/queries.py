"""The registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from mediasift.llm import conversations, decontaminate, fingerprint, langid, licenses, linededup, minhash, mixture, packing, pii, quality, secrets, veccodes

QUERIES = {
    "op1_language_id": langid.query,
    "op2_line_dedup": linededup.query,
    "op3_decontaminate": decontaminate.query,
    "op4_near_duplicates": minhash.query,
    "op5_secrets": secrets.query,
    "op6_fingerprints": fingerprint.query,
    "op7_packing": packing.query,
    "op8_pii": pii.query,
    "op9_quality": quality.query,
    "op10_licenses": licenses.query,
    "op11_conversation_repair": conversations.query,
    "op12_mixture_packing": mixture.query,
    "op13_vector_codes": veccodes.query,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op3_decontaminate": decontaminate.SQL,
    "op5_secrets": secrets.sql(),
    "op10_licenses": licenses.sql(),
    "op11_conversation_repair": conversations.SQL,
    "op13_vector_codes": veccodes.SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
