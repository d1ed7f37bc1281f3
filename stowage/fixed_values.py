"""Values that decide results and therefore have to be exactly these.

Everything here is plain data: word lists, thresholds and patterns. Operators
take them as defaults, so a caller can pass other ones.
"""

# Extensions of each content category.
VIDEO_EXTENSIONS = [
    ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v",
    ".mpg", ".mpeg", ".3gp", ".ts",
]
IMAGE_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".tiff",
    ".tif", ".ico", ".heic", ".heif", ".raw", ".cr2", ".nef",
]
DOCUMENT_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt",
    ".ods", ".odp", ".txt", ".rtf", ".md", ".tex", ".epub", ".csv",
]
ARCHIVE_EXTENSIONS = [
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".iso",
    ".dmg", ".pkg", ".deb", ".rpm", ".tgz",
]
CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h",
    ".hpp", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".kt",
    ".scala", ".r", ".m", ".sh", ".bash", ".zsh", ".ps1", ".bat",
    ".sql", ".html", ".css", ".scss", ".less", ".vue", ".svelte",
    ".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".cfg",
    ".dockerfile", ".makefile",
]
AUDIO_EXTENSIONS = [
    ".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a", ".opus",
    ".aiff", ".alac",
]
DATA_EXTENSIONS = [
    ".db", ".sqlite", ".sqlite3", ".mdb", ".accdb", ".parquet",
    ".feather", ".arrow", ".hdf5", ".h5", ".npy", ".npz", ".pkl",
    ".pickle", ".pt", ".pth", ".ckpt", ".onnx", ".safetensors",
]

# Code is asked first: ".ts" stands in two lists and counts as code.
CATEGORY_EXTENSIONS = {
    "code": CODE_EXTENSIONS,
    "video": VIDEO_EXTENSIONS,
    "image": IMAGE_EXTENSIONS,
    "document": DOCUMENT_EXTENSIONS,
    "archive": ARCHIVE_EXTENSIONS,
    "audio": AUDIO_EXTENSIONS,
    "data": DATA_EXTENSIONS,
}

# Exclusion rules that every new store starts with.
SEEDED_NAME_RULES = [
    ".git", ".svn", "__pycache__", ".DS_Store", "Thumbs.db", "$Recycle.Bin",
    "System Volume Information", ".Spotlight-V100", ".fseventsd", ".Trashes",
    ".Trash", "Library",
]

# Exclusion rules per platform, as (pattern, rule type).
PLATFORM_RULES = {
    "darwin": [
        ("/System", "path"), ("/Library", "path"), ("Library", "name"),
        (".Spotlight-V100", "name"), (".fseventsd", "name"),
        (".Trashes", "name"), (".Trash", "name"), (".DS_Store", "name"),
    ],
    "linux": [
        ("/proc", "path"), ("/sys", "path"), ("/dev", "path"),
        ("/run", "path"), ("/snap", "path"),
    ],
    "win32": [
        ("$Recycle.Bin", "name"), ("System Volume Information", "name"),
        ("pagefile.sys", "name"), ("hiberfil.sys", "name"),
        ("swapfile.sys", "name"),
    ],
}

# Staleness.
ACTIVE_DAYS = 30
AGING_DAYS = 180
STALE_DAYS = 365
UNKNOWN_AGE_DAYS = 9999.0
ACCESS_WEIGHT = 0.3
MODIFY_WEIGHT = 0.7
SIGMOID_STEEPNESS = 0.015
SIGMOID_MIDPOINT_DAYS = 180
STALE_SCORE = 0.5
SCORE_TIERS = [("active", 0.1), ("aging", 0.5), ("stale", 0.85)]
TIER_NAMES = ["active", "aging", "stale", "archive_candidate"]
ARTIFACT_DIRECTORIES = [
    "node_modules", ".venv", "venv", "__pycache__", ".tox",
    "target", "build", "dist", ".gradle", ".cache",
    ".pytest_cache", ".mypy_cache", ".ruff_cache",
    "coverage", "htmlcov", ".next", ".nuxt",
]
LOW_RISK_CATEGORIES = ["archive", "audio", "video", "data"]
HIGH_RISK_CATEGORIES = ["code", "document"]

# Path patterns of the artifact summary, which may overlap.
ARTIFACT_LIKE_PATTERNS = [
    ("node_modules", "%/node_modules/%"),
    ("python_venv", "%/.venv/%"),
    ("python_venv", "%/venv/%"),
    ("pycache", "%/__pycache__/%"),
    ("build_output", "%/build/%"),
    ("build_output", "%/dist/%"),
    ("build_output", "%/target/%"),
    ("gradle", "%/.gradle/%"),
    ("cache", "%/.cache/%"),
    ("next_cache", "%/.next/%"),
]

# Workspace artifact patterns in order of precedence, as
# (pattern, workspace type, artifact type, risk, safe to delete).
WORKSPACE_PATTERNS = [
    ("/.venv/", "python", ".venv", "low", True),
    ("/venv/", "python", "venv", "low", True),
    ("/__pycache__/", "python", "__pycache__", "low", True),
    ("/.tox/", "python", ".tox", "low", True),
    ("/.mypy_cache/", "python", ".mypy_cache", "low", True),
    ("/.pytest_cache/", "python", ".pytest_cache", "low", True),
    ("/.ruff_cache/", "python", ".ruff_cache", "low", True),
    ("/site-packages/", "python", "site-packages", "low", True),
    ("/node_modules/", "node", "node_modules", "low", True),
    ("/.next/", "node", ".next", "low", True),
    ("/.nuxt/", "node", ".nuxt", "low", True),
    ("/bower_components/", "node", "bower_components", "low", True),
    ("/target/classes/", "java", "target", "low", True),
    ("/target/test-classes/", "java", "target", "low", True),
    ("/.gradle/", "java", ".gradle", "low", True),
    ("/build/classes/", "java", "build", "low", True),
    ("/build/libs/", "java", "build", "low", True),
    ("/target/debug/", "rust", "cargo_target", "low", True),
    ("/target/release/", "rust", "cargo_target", "low", True),
    ("/.docker/", "docker", "docker_cache", "medium", False),
    ("/docker/volumes/", "docker", "docker_volumes", "medium", False),
    ("/.cache/huggingface/", "ml", "huggingface_cache", "medium", False),
    ("/.cache/torch/", "ml", "torch_cache", "medium", False),
    ("/checkpoints/", "ml", "checkpoints", "medium", False),
    ("/.idea/", "ide", ".idea", "low", True),
    ("/.vscode/", "ide", ".vscode", "low", True),
    ("/.vs/", "ide", ".vs", "low", True),
    ("/dist/", "node", "dist", "medium", False),
    ("/coverage/", "node", "coverage", "low", True),
    ("/htmlcov/", "python", "htmlcov", "low", True),
]
MODEL_EXTENSIONS = [".pt", ".pth", ".ckpt", ".onnx", ".safetensors", ".h5", ".pb"]
MEDIUM_RISK_WORKSPACES = ["docker", "ml"]
INACTIVE_DAYS = 180
UNKNOWN_INACTIVE_DAYS = 9999
INACTIVITY_BUCKETS = [("under_6_months", 180), ("6_to_12_months", 365), ("1_to_2_years", 730)]
DOWNLOAD_EXTENSIONS = [
    ".zip", ".tar", ".gz", ".tgz", ".7z", ".rar",
    ".exe", ".msi", ".dmg", ".pkg", ".deb", ".rpm", ".iso", ".pdf",
]

# Suffixes that mark a copy of a project, removed in this order.
PROJECT_SUFFIX_PATTERNS = [
    r"(?i)[-_\s]*(copy|backup|bak|old|archive|final|v\d+|ver\d+)[-_\s]*\d*$",
    r"(?i)[-_\s]+\d+$",
    r"(?i)\s*\(\d+\)$",
]

# Duplicates.
MIN_DUPLICATE_BYTES = 1024
PARTIAL_BYTES = 4096
MAX_HASHED_BYTES = 10 * 1024**3

# Forecasts.
MOVING_WINDOW = 7
SMOOTHING_ALPHA = 0.3
LINEAR_R2 = 0.85
HIGH_VARIATION = 0.5
MAX_DAYS_UNTIL_FULL = 99999
TREND_LIMITS = [
    ("stable", 0.5), ("slow_growth", 2.0), ("moderate_growth", 5.0), ("rapid_growth", 10.0),
]

# Recommendations.
KIB = 1024
MIB = 1024**2
GIB = 1024**3
PRIORITY_ORDER = ["critical", "high", "medium", "low"]
REGENERABLE_WORKSPACES = ["node", "python", "java", "rust"]

# Cleanup actions.
ALLOWED_TRANSITIONS = [
    ("proposed", "dry_run_complete"),
    ("proposed", "approved"),
    ("dry_run_complete", "approved"),
    ("approved", "executing"),
    ("executing", "completed"),
    ("executing", "failed"),
    ("completed", "rolled_back"),
    ("failed", "rolled_back"),
]
ACTION_TYPES = ["trash", "archive", "compress"]
TERMINAL_EVENTS = ["completed", "failed", "cancelled"]

# Texts of recommendations as (title, description, explanation).
# Words in braces are columns of the context row.
RECOMMENDATION_TEXTS = {
    "growth_warning": (
        "Disk may be full in {days} days",
        "At the current growth rate of {monthly}/month, the remaining {free} of free space "
        "will be exhausted in approximately {days} days.",
        "Storage growth averaging {daily}/day has been detected. Proactive cleanup or "
        "additional storage is recommended to prevent disruption.",
    ),
    "duplicates": (
        "Remove {groups} duplicate file groups",
        "Found {groups} groups of identical files consuming {wasted} of redundant storage.",
        "SHA256-verified duplicate detection identified {groups} groups. Most common duplicate "
        "types: {extensions}. Keeping one copy of each and removing the rest would recover "
        "{wasted}.",
    ),
    "regenerable": (
        "Remove regenerable developer artifacts",
        "Found {safe} in safely removable artifacts (node_modules, __pycache__, build outputs, "
        ".venv). These can be regenerated with a single command.",
        "Developer build artifacts are fully regenerable from source. Removing them frees "
        "{safe} immediately. Run `npm install`, `pip install`, or `gradle build` to restore "
        "when needed.",
    ),
    "abandoned": (
        "Review {inactive} abandoned developer projects",
        "{inactive} projects have not been modified in 6+ months. Consider archiving or "
        "removing them.",
        "Inactive projects consume space and add clutter. If they are no longer needed, "
        "archiving to a compressed backup or removing them entirely would reduce workspace "
        "overhead.",
    ),
    "workspace_type": (
        "Clean {type} workspace artifacts ({recoverable})",
        "{count} {type} workspace(s) contain {recoverable} of recoverable artifacts.",
        "The {type} ecosystem accumulates significant cache and build artifacts over time. "
        "Periodic cleanup is recommended.",
    ),
    "archive": (
        "Archive {count} files unused for over 1 year",
        "{count} files ({bytes}) have not been accessed in over 365 days and are strong "
        "candidates for archival or removal.",
        "These files show zero access activity for 1+ year. Archiving them would recover "
        "{bytes} with minimal risk since they haven't been needed.",
    ),
    "stale": (
        "Review {count} stale files for cleanup",
        "{count} files ({bytes}) have not been accessed in 6-12 months. Review for potential "
        "removal or archival.",
        "Files inactive for 6-12 months are unlikely to be needed but may contain important "
        "data. Manual review recommended before deletion.",
    ),
    "large_files": (
        "Review {count} files over 1 GB",
        "Found {count} files larger than 1 GB, totaling {bytes}. Review whether these are "
        "still needed.",
        "Large files are the fastest way to recover significant space. Common offenders "
        "include old VM images, database dumps, video recordings, and ML model checkpoints.",
    ),
}
