from trafficlens.sources.hours import coverage_gaps, expected_hours, first_version, list_dumps, other_files, paths_for_hours
from trafficlens.sources.tables import events_as_traffic, read_traffic_table, table_bounds
from trafficlens.sources.text import (
    parse_dump_lines,
    read_anomalies,
    read_dump_file,
    read_dumps,
    read_folder,
    read_traffic,
    read_whitelist,
)

__all__ = [
    "coverage_gaps",
    "events_as_traffic",
    "expected_hours",
    "first_version",
    "list_dumps",
    "other_files",
    "parse_dump_lines",
    "paths_for_hours",
    "read_anomalies",
    "read_dump_file",
    "read_dumps",
    "read_folder",
    "read_traffic",
    "read_traffic_table",
    "read_whitelist",
    "table_bounds",
]
