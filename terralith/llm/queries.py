"""Registered queries of this subpackage and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from terralith.llm import abuse, canonical, grouping, leaks, mixing, overlap, sampling, sql


def queries() -> dict:
    return {
        "p1_found": sampling.p1_found,
        "p1_report": sampling.p1_report,
        "p1_sample": sampling.p1_sample,
        "p2_found": grouping.p2_found,
        "p2_split": grouping.p2_split,
        "p2_report": grouping.p2_report,
        "p3_found": canonical.p3_found,
        "p3_unmatched": canonical.p3_unmatched,
        "p5_found": overlap.p5_found,
        "p5_classes": overlap.p5_classes,
        "p5_report": overlap.p5_report,
        "p6_found": leaks.p6_found,
        "p6_report": leaks.p6_report,
        "p7_found": mixing.p7_found,
        "p7_report": mixing.p7_report,
        "p7_mix": mixing.p7_mix,
        "p8_found": abuse.p8_found,
        "p8_report": abuse.p8_report,
        "p8_scores": abuse.p8_scores,
        "p8_holdout": abuse.p8_holdout,
    }


def oracle_sql() -> dict:
    return {"p1_found": sql.p1_found(), "p2_found": sql.p2_found()}
