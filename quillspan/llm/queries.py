"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillspan.llm import dedup, html_extract, langid, ngram_join, packing, pii, quality, sp_codec, tokens, topk
from quillspan.llm.common import read


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.query,
        "op2_topk": topk.query,
        "op3_packing": packing.query,
        "op5_exact_dedup": lambda spark, sf_dir: dedup.exact_dedup(read(spark, sf_dir, "documents")),
        "op4_sentencepiece": sp_codec.query,
        "op6_html": html_extract.query,
        "op7_language": langid.query,
        "op9_token_counts": tokens.query,
        "op8_quality": quality.query,
        "op10_pii": pii.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.SQL, "op5_exact_dedup": dedup.SQL}
