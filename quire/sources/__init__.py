"""Reading files, path lists and version-control text."""

from quire.sources.files import read_archive, read_binary_files, scan_directories
from quire.sources.lists import read_artifacts, read_name_status, read_patches, read_path_list

__all__ = [
    "read_archive", "read_artifacts", "read_binary_files", "read_name_status", "read_patches",
    "read_path_list", "scan_directories",
]
