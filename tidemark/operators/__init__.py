"""Data operators: schema conformance, allow-lists, counts, comparison, lineage cuts."""

from tidemark.operators.aggregates import group_count, row_count
from tidemark.operators.compare import assert_frames_equal, compare_frames
from tidemark.operators.filters import allow_from, allow_list
from tidemark.operators.lineage import cut_lineage
from tidemark.operators.schema import check_id, conform, declare_schema, id_report, stamp_period

__all__ = [
    "group_count", "row_count", "assert_frames_equal", "compare_frames", "allow_from", "allow_list",
    "cut_lineage", "check_id", "conform", "declare_schema", "id_report", "stamp_period",
]
