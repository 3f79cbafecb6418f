"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from factorloom.llm import alignment, lexical, mixing, near_dedup, nearest, packing, quality_rules, repeats, rule_ensemble, secrets, token_files, url_filters, warc


def queries() -> dict:
    return {
        "op1_near_duplicates": near_dedup.op1_near_duplicates,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_rule_classifier": rule_ensemble.op3_rule_classifier,
        "op4_nearest": nearest.op4_nearest,
        "op5_packing": packing.op5_packing,
        "op6_url_filters": url_filters.op6_url_filters,
        "op7_warc": warc.op7_warc,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_token_files": token_files.op9_token_files,
        "op10_mix": mixing.op10_mix,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_lexical_search": lexical.op12_lexical_search,
        "op13_substring_dedup": repeats.op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": near_dedup.op1_sql(), "op4_nearest": nearest.op4_sql(), "op6_url_filters": url_filters.op6_sql(), "op7_warc": warc.op7_sql(), "op10_mix": mixing.op10_sql(), "op12_lexical_search": lexical.op12_sql(),
            "op13_substring_dedup": repeats.op13_sql()}
