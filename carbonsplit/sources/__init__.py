"""Reading inputs, writing results, and cutting lineage at shared tables."""

from carbonsplit.sources.shared import (
    bucketed_table,
    passing_tables,
    release_tables,
    shared_folder,
    shared_path,
    shared_table,
    written_tables,
)
from carbonsplit.sources.tables import (
    SCHEMAS,
    counted_csv,
    counted_sheet,
    read_csv,
    read_parquet,
    rename_to_domain,
    wide_sheet,
    write_result,
)

__all__ = [
    "SCHEMAS",
    "bucketed_table",
    "counted_csv",
    "counted_sheet",
    "passing_tables",
    "read_csv",
    "read_parquet",
    "release_tables",
    "rename_to_domain",
    "shared_folder",
    "shared_path",
    "shared_table",
    "wide_sheet",
    "write_result",
    "written_tables",
]
