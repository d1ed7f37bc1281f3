"""Column layouts of the tables that the operators read and write."""

from pyspark.sql import types as T

INVENTORY = (
    "scan_id string, file_id string, path string, directory string, filename string, "
    "extension string, size_bytes bigint, category string, created_at timestamp, "
    "modified_at timestamp, accessed_at timestamp, owner string, permissions string"
)
CONTENT = (
    "file_id string, path string, extension string, size_bytes bigint, content binary, "
    "modified_at timestamp"
)
FOLDERS = (
    "scan_id string, path string, name string, parent_path string, depth int, "
    "total_size_bytes bigint, file_count bigint, dir_count bigint"
)
SCANS = (
    "scan_id string, root_path string, status string, scan_type string, started_at timestamp, "
    "completed_at timestamp, total_files bigint, total_dirs bigint, total_size_bytes bigint, "
    "error_count bigint, created_at timestamp"
)
RULES = "pattern string, rule_type string, is_active boolean"
SNAPSHOTS = (
    "volume_id string, snapshot_date date, total_size_bytes bigint, used_size_bytes bigint, "
    "file_count bigint, dir_count bigint"
)
TASK_EVENTS = (
    "task_id string, event_id bigint, event_type string, ts timestamp, "
    "metrics map<string,double>"
)
ACTION_EVENTS = "action_id string, event_id bigint, status string, ts timestamp"


def struct_of(ddl: str) -> T.StructType:
    """The StructType of one of the layouts above."""
    return T.StructType.fromDDL(ddl)
