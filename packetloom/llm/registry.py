"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import decontam, licenses, mixing, pii, substrings
from packetloom.llm.decontam import op3_decontamination
from packetloom.llm.html import op10_html_extraction
from packetloom.llm.iblt import op9_fingerprints
from packetloom.llm.langid import op2_language_id
from packetloom.llm.licenses import op5_license_scan
from packetloom.llm.mixing import op8_mixing
from packetloom.llm.pii import op1_pii
from packetloom.llm.simhash import op4_simhash_near_dedup
from packetloom.llm.substrings import op6_substring_dedup
from packetloom.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_fingerprints": op9_fingerprints,
    "op10_html_extraction": op10_html_extraction,
    # columns of the above that SQL can express
    "pii_base": pii.pii_base,
    "license_base": licenses.license_base,
    "mixing_targets": mixing.mixing_targets,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontam.ORACLE,
    "op6_substring_dedup": substrings.ORACLE,
    "pii_base": pii.BASE_ORACLE,
    "license_base": licenses.BASE_ORACLE,
    "mixing_targets": mixing.TARGETS_ORACLE,
}
