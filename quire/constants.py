"""Names, tables, limits and text formats that decide results.

Nothing in here is computed; changing a value changes what gets exported.
"""

from __future__ import annotations

# --- limits -----------------------------------------------------------------
DEFAULT_MAX_FILE_BYTES = 100 * 1024
DEFAULT_WARN_TOKENS = 200_000
DEFAULT_HUNK_CONTEXT = 3
SHEBANG_BYTES = 255

# --- ignore rules applied before the caller's own ----------------------------
DEFAULT_IGNORE_RULES = (
    ".git/", "node_modules/", "build/", "dist/", "bin/", ".env", ".venv/",
    "__pycache__/", ".DS_Store", "*.o", "*.a", "*.so", "*.exe", "*.dll", "*.log",
)

# --- fence language by file extension, file name and script interpreter ------
LANGUAGE_BY_EXTENSION = {
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "py": "python",
    "js": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "html": "html", "css": "css", "java": "java", "php": "php",
    "sql": "sql", "xml": "xml", "json": "json", "md": "markdown", "sh": "bash",
    "yml": "yaml", "yaml": "yaml",
    "go": "go", "rs": "rust", "kt": "kotlin", "cs": "csharp", "rb": "ruby",
    "lua": "lua", "toml": "toml", "ini": "ini",
    "dockerfile": "dockerfile", "makefile": "makefile", "cmake": "cmake",
    "swift": "swift", "m": "objective-c", "mm": "objective-c",
    "ps1": "powershell", "bat": "batch", "r": "r", "scala": "scala",
    "proto": "protobuf",
}
LANGUAGE_BY_FILE_NAME = {
    "dockerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile",
}
LANGUAGE_BY_INTERPRETER = {
    "python": "python", "python3": "python",
    "bash": "bash", "sh": "bash", "zsh": "bash",
    "node": "javascript", "nodejs": "javascript",
    "ruby": "ruby", "perl": "perl", "lua": "lua",
    "pwsh": "powershell", "powershell": "powershell",
}

# --- export modes: label and the sentence that ends the artifact header ------
MODE_DESCRIPTIONS = {
    "auto": "Below are the source files of this repository.",
    "recursive": "Below are the source files found in the folders of this repository.",
    "worktree": "Below are the tracked files, and new ones that no rule ignores.",
    "staged": "Below are the files with staged changes.",
    "unstaged": "Below are the tracked files with changes that are not staged.",
    "diff": "Below are the files that differ between two states.",
    "stdin": "Below are the files that a path list names.",
}
DELTA_MODES = ("staged", "unstaged", "diff")

# --- artifact text -----------------------------------------------------------
TITLE = "# Codebase Export"
CONTEXT_HEADING = "## Change Context"
TREE_HEADING = "## Project Tree"
EMPTY_TREE_LINE = "(no exported files)"
FILES_BEGIN = "<!-- FILES BEGIN -->"
FILES_END = "<!-- FILES END -->"
TREE_BRANCH = "├── "
TREE_LAST = "└── "
TREE_PIPE = "│   "
TREE_SPACE = "    "
LINE_NUMBERS_FLAG = "Line numbers: on"
HUNKS_FLAG = "Hunks: on"

# --- skip reasons, in the order they are tested ------------------------------
SKIP_SYMLINK = "symlink"
SKIP_NOT_REGULAR = "not_regular"
SKIP_UNREADABLE_DIR = "unreadable_dir"
SKIP_TOO_LARGE = "too_large"
SKIP_IGNORED = "ignored"
SKIP_SENSITIVE_NAME = "sensitive_name"
SKIP_CHANGED = "changed"
SKIP_UNREADABLE = "unreadable"
SKIP_EMPTY = "empty"
SKIP_BINARY = "binary"
SKIP_SENSITIVE_CONTENT = "sensitive_content"
