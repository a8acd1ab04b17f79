"""Scan limits, file selection, manifest names."""

MAX_FILES = 1_000
MAX_ARCHIVE_BYTES = 50 * 1024 * 1024
MAX_REPO_BYTES = 50 * 1024 * 1024
MAX_FILE_BYTES = 512_000
MAX_LINE_CHARS = 2_000
MAX_TEXT_CHARS = 50_000
FREE_FINDINGS = 5
REPO_HOSTS = ("github.com",)
REPO_URL_PREFIX = "https://github.com/"

SCAN_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".env", ".cfg", ".ini", ".conf", ".config",
    ".yaml", ".yml", ".toml", ".json", ".xml", ".sh", ".bash", ".zsh", ".fish",
    ".rb", ".php", ".java", ".go", ".rs", ".cs", ".tf", ".tfvars", ".properties",
    ".pem", ".key", ".crt", ".txt", ".md", ".html", ".htaccess", "",
)
SCAN_SKIP_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next",
    ".nuxt", "vendor", "target", ".mypy_cache", ".pytest_cache", ".tox", "coverage",
)
MANIFEST_SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")

# Priority order: lock files (exact versions) come first.
MANIFESTS = (
    "package-lock.json", "poetry.lock", "Pipfile.lock",
    "requirements.txt", "package.json", "Pipfile",
)
