"""Explicit schemas of the extracted tables; nothing is inferred on read."""

from __future__ import annotations

_RECT = "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"

TABLES = {
    "doc_file": "doc_id BIGINT, path STRING, size_bytes BIGINT, modified_ns BIGINT, device BIGINT, inode BIGINT, sha256 STRING",
    "preflight": "doc_id BIGINT, path STRING, pages INT, has_forms BOOLEAN, needs_pass BOOLEAN, is_pdf BOOLEAN, reason STRING",
    "doc_page": f"doc_id BIGINT, page_no INT, {_RECT}, text_chars BIGINT",
    "text_line": f"doc_id BIGINT, page_no INT, line_no INT, text STRING, {_RECT}",
    "drawing": f"doc_id BIGINT, page_no INT, draw_no BIGINT, {_RECT}, item_arity ARRAY<INT>",
    "image_placement": f"doc_id BIGINT, page_no INT, placement_no BIGINT, xref BIGINT, smask BIGINT, width INT, height INT, {_RECT}",
    "stream_size": "doc_id BIGINT, xref BIGINT, bytes BIGINT",
    "page_stream": "doc_id BIGINT, page_no INT, xref BIGINT, role STRING",
    "asset": (
        "doc_id BIGINT, key STRING, kind STRING, page_runs ARRAY<STRUCT<first: INT, last: INT>>, xref BIGINT, smask BIGINT, width INT, height INT, "
        "rect STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>, title STRING, storage_bytes BIGINT, storage_is_estimate BOOLEAN"
    ),
    "variant": "doc_id BIGINT, key STRING, asset_ord BIGINT, level INT, score INT, payload_bytes BIGINT, visual_weight DOUBLE",
    "candidate": "doc_id BIGINT, stage STRING, score INT, size_bytes BIGINT, images INT, vectors INT, figures INT",
    "target": "doc_id BIGINT, original_bytes BIGINT, lossless_bytes BIGINT, overhead_bytes BIGINT, target_bytes BIGINT",
    "selection": "doc_id BIGINT, key STRING",
    "plan_node": "plan_id BIGINT, uid STRING, parent_uid STRING, ord INT, title STRING, source STRING, page_index BIGINT",
    "page_ref": "plan_id BIGINT, pos INT, source BIGINT, page_index BIGINT",
    "merge_input": "merge_id BIGINT, pos INT, doc_id BIGINT, pages INT, size_bytes BIGINT",
    "link": f"doc_id BIGINT, page_no INT, link_no INT, kind STRING, {_RECT}, target_page INT, target_x DOUBLE, target_y DOUBLE, uri STRING",
    "toc": "doc_id BIGINT, pos INT, level INT, title STRING, page_no INT, dest_x DOUBLE, dest_y DOUBLE",
    "render_task": f"batch_id BIGINT, id INT, page_no INT, {_RECT}, dpi INT, quality INT, group_id INT",
    "job_event": "job_id BIGINT, seq BIGINT, ts TIMESTAMP, generation INT, kind STRING, progress INT",
    "page_gray": "doc_id BIGINT, variant STRING, page_no INT, width INT, height INT, pixels ARRAY<INT>",
}

MANIFEST = (
    "doc_id BIGINT, item_count INT, figure_count INT, standalone_image_count INT, svg_count INT, png_count INT, "
    "pdf_count INT, requested_formats ARRAY<STRING>, payload_bytes BIGINT, "
    "items ARRAY<STRUCT<index: INT, source_asset_key: STRING, type: STRING, source_pages: ARRAY<INT>, title: STRING, "
    "files: MAP<STRING, STRING>>>"
)

_RUN = (
    "`case` STRING, label STRING, seconds DOUBLE, pages INT, bytes BIGINT, target BIGINT, native BOOLEAN, "
    "link_count INT, text_preserved BOOLEAN, render_hashes ARRAY<STRING>"
)
_FIXTURE = "STRUCT<name: STRING, bytes: BIGINT, pages: INT, sha256: STRING>"
REPORT = (
    f"label STRING, stress_sha256 STRING, baseline STRING, current STRING, runs ARRAY<STRUCT<{_RUN}>>, "
    f"fixtures STRUCT<source: {_FIXTURE}, ppt_reference: {_FIXTURE}, stress: {_FIXTURE}>"
)
FIXTURE_NAMES = ("source", "ppt_reference", "stress")
