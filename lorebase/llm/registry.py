"""Queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, lattice, media, mixing, neardup, quality, secrets, suffix, urlrules

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_media_columns": media.op1_media_columns,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality": quality.op3_quality,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_url_filter": urlrules.op7_url_filter,
    "op8_lattice_scores": lattice.op8_lattice_scores,
    "op9_chat_format": chat.op9_chat_format,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
}

ORACLES = {
    "op4_decontamination": decontaminate.ORACLE,
    "op5_near_duplicates": neardup.ORACLE,
    "op7_url_filter": urlrules.ORACLE,
    "op9_chat_format": chat.ORACLE,
}
