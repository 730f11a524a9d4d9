"""Reading transfer data sets: files, archives, adapters by name."""

from .adapters import ADAPTERS, Adapter, load_dataset, resolve_adapter
from .files import extract_zip, find_file, find_tabular, require_files
from .readers import read_csv, read_lines, read_parquet, read_table

__all__ = ["ADAPTERS", "Adapter", "extract_zip", "find_file", "find_tabular", "load_dataset", "read_csv", "read_lines", "read_parquet", "read_table", "require_files", "resolve_adapter"]
