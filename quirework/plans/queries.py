"""All registered queries."""

from quirework.plans import (  # noqa: F401
    queries_audit,
    queries_budget,
    queries_compose,
    queries_figures,
    queries_scalar,
)
from quirework.plans.registry import ORACLES, QUERIES  # noqa: F401

# Sums of BIGINT are wider than BIGINT in the checking engine; bring them back to it.
WHOLE_NUMBERS = {
    "a2_load_tables": ("items",),
    "a3_load_runs": ("bytes",),
    "a4_write_manifest": ("payload_bytes", "pages"),
    "a6_publish": ("original_bytes",),
    "b8_quality_ladder": ("width",),
    "c9_offset_bookmarks": ("page_no",),
    "c9_offset_links": ("page_no", "target_page"),
    "compress_to_target": ("original_bytes", "output_bytes"),
    "d10_outcome_at_floor": ("original_bytes", "output_bytes"),
    "d11_export_summary": ("payload_bytes",),
    "d21_choose_method": ("result_bytes",),
    "d23_better_selection": ("stream_bytes",),
    "d23_selection_totals": ("stream_bytes",),
    "d3_figure_storage": ("storage_bytes",),
    "d5_asset_catalog_g1_union": ("storage_bytes",),
    "d6_selection_summary": ("bytes",),
    "d7_queue_summary": ("pages", "bytes"),
    "d8_composition_summary": ("used_bytes",),
    "d9_compose_summary": ("pages", "input_bytes"),
    "d9_merge_summary": ("pages", "input_bytes"),
    "e2_page_offsets": ("page_offset",),
    "e3_page_runs": ("run_no",),
    "i12_stream_budget": ("stream_budget",),
}
for _name, _cols in WHOLE_NUMBERS.items():
    _casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _cols)
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM (\n{ORACLES[_name]}\n)"
