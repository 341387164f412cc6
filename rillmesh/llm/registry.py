"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, fingerprints, language_id, packing, secrets, sharding, simhash, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_syncmers": fingerprints.op4_syncmers,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_warc": warc.op8_warc,
    "op9_sharding": sharding.op9_sharding,
    "op10_secrets": secrets.op10_secrets,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": chat_format.OP3_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_sharding": sharding.OP9_SQL,
}
