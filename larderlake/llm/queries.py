"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import decontaminate, langid, media, mixing, ngram_join, pii, quality, repeats, tokens, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_ngram_join": ngram_join.query,
    "op3_decontaminate": decontaminate.query,
    "op4_mixing": mixing.query,
    "op5_repeats": repeats.query,
    "op6_langid": langid.query,
    "op7_pii": pii.query,
    "op8_tokens": tokens.query,
    "op9_media": media.query,
    "op10_warc": warc.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op5_repeats": repeats.ORACLE_SQL,
    "op7_pii": pii.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}
