"""The registered queries of this package: ``(spark, sf_dir) -> DataFrame``, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from .cap_filters import cap_filters
from .filter_audit import AUDIT_SQL, filter_audit
from .html_extract import html_extract
from .license_scan import license_scan
from .line_dedup import LINE_SQL, line_dedup
from .packing import packing
from .periodic_runs import periodic_runs
from .quality_rules import quality_rules
from .sentencepiece_scan import sentencepiece_scan
from .simhash import simhash
from .suffix_dedup import suffix_dedup
from .topk_search import TOPK_SQL, topk_search
from .toxicity import toxicity

QUERIES = {
    "op1_html_extract": html_extract,
    "op2_line_dedup": line_dedup,
    "op3_packing": packing,
    "op4_suffix_dedup": suffix_dedup,
    "op5_toxicity": toxicity,
    "op6_quality_rules": quality_rules,
    "op7_simhash": simhash,
    "op8_cap_filters": cap_filters,
    "op9_license_scan": license_scan,
    "op10_sentencepiece": sentencepiece_scan,
    "op11_topk_search": topk_search,
    "op12_filter_audit": filter_audit,
    "op13_periodic_runs": periodic_runs,
}
ORACLES = {
    "op2_line_dedup": LINE_SQL,
    "op11_topk_search": TOPK_SQL,
    "op12_filter_audit": AUDIT_SQL,
}
