"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from prismal.llm import decontamination, htmltext, licenses, linededup, mixing, neardup, oracles, quality, substrings, tokencount, urlfilter


def queries() -> dict:
    return {
        "op1_token_counts": tokencount.op1_token_counts,
        "op2_mixing": mixing.op2_mixing,
        "op3_html_text": htmltext.op3_html_text,
        "op4_quality": quality.op4_quality,
        "op5_url_filter": urlfilter.op5_url_filter,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_licenses": licenses.op8_licenses,
        "op9_near_dedup": neardup.op9_near_dedup,
        "op10_decontamination": decontamination.op10_decontamination,
        "pipeline": _pipeline,
    }


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
