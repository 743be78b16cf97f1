"""Column expressions on file paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of each file ending.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby",
    "php": "php", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "r": "r", "sql": "sql",
    "sh": "bash", "bash": "bash", "zsh": "bash", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "html": "html", "css": "css", "scss": "scss",
    "vue": "vue", "svelte": "svelte",
}
# Endings of files that are embedded, and folders that are skipped.
CODE_ENDINGS = ["py", "js", "jsx", "ts", "tsx", "java", "go", "rs", "rb", "php", "c", "cpp", "h", "hpp", "cs", "swift", "kt", "scala"]
SKIPPED_FOLDERS = ["node_modules", "vendor", "__pycache__", ".git", "dist", "build", ".next", "coverage", ".venv", "venv"]
# How much code in a folder matters.
LOCATION_SCORES = {
    "services": 100, "service": 100, "api": 90, "routes": 90, "endpoints": 90, "models": 80, "model": 80, "workers": 70, "worker": 70, "tasks": 70,
    "components": 60, "component": 60, "lib": 40, "utils": 40, "util": 40, "helpers": 40, "helper": 40, "common": 40, "tests": 20, "test": 20, "__tests__": 20,
}
DEFAULT_LOCATION = 50
# The layer a folder names.
LAYERS = {
    "models": "models", "model": "models", "services": "services", "service": "services", "api": "api", "apis": "api", "endpoints": "api", "routes": "api",
    "tests": "tests", "test": "tests", "__tests__": "tests", "utils": "utils", "util": "utils", "utilities": "utils", "helpers": "utils", "helper": "utils",
    "lib": "utils", "common": "utils", "workers": "workers", "worker": "workers", "tasks": "workers", "jobs": "workers",
}
# What marks the path of a test.
TEST_MARKS = ["test_", "_test.", ".test.", ".spec.", "/tests/", "/__tests__/", "tests/", "__tests__/"]
# Names of entry points and of configuration files, folders of core and of interface code, endings by kind.
ENTRY_NAMES = [
    "main.py", "app.py", "index.py", "__main__.py", "manage.py", "wsgi.py", "asgi.py", "index.js", "index.ts", "main.js", "main.ts", "app.js", "app.ts", "server.js",
    "server.ts", "index.jsx", "index.tsx", "App.jsx", "App.tsx", "main.go", "Main.java", "Program.cs", "main.rs", "lib.rs",
]
CONFIG_NAMES = [
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "package.json", "tsconfig.json", "webpack.config.js", "vite.config.ts", "next.config.js",
    "next.config.ts", "tailwind.config.js", "tailwind.config.ts", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Gemfile", "composer.json", "Dockerfile",
    "docker-compose.yml", "docker-compose.yaml", ".env.example", "alembic.ini",
]
CORE_FOLDERS = ["src", "lib", "core", "services", "domain", "models", "entities", "utils", "helpers", "common", "alembic", "migrations"]
API_FOLDERS = ["api", "routes", "controllers", "handlers", "endpoints", "views", "resources"]
SOURCE_ENDINGS = [*CODE_ENDINGS, "vue", "svelte"]
CONFIG_ENDINGS = ["json", "yaml", "yml", "toml", "ini", "cfg", "conf"]
DOC_ENDINGS = ["md", "rst", "txt"]


def segments(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def ending(path: Column) -> Column:
    """The ending without its dot, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([A-Za-z0-9]+)$", 1))


def suffix(path: Column) -> Column:
    """As ``ending``, but a name that only begins with its dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def directory(path: Column, root: str = "") -> Column:
    got = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), got).otherwise(F.lit(root))


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def first_known(table: dict, parts: Column) -> Column:
    """The value of the first element that is a key of the table; null where none is."""
    keys = F.array(*map(F.lit, table))
    hit = F.filter(parts, lambda p: F.array_contains(keys, p))
    return F.when(F.size(hit) > 0, lookup(table, F.get(hit, F.lit(0))))


def language(path: Column, other: str = "text") -> Column:
    e = ending(path)
    return F.when(e.isin(list(LANGUAGES)), lookup(LANGUAGES, e)).otherwise(F.lit(other))


def location_score(path: Column) -> Column:
    return F.coalesce(first_known(LOCATION_SCORES, segments(F.lower(path))), F.lit(DEFAULT_LOCATION))


def layer(path: Column) -> Column:
    return F.coalesce(first_known(LAYERS, segments(F.lower(path))), F.lit("unknown"))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a | b, [low.contains(m) for m in TEST_MARKS])


def same_layer(a: Column, b: Column) -> Column:
    la, lb, da = layer(a), layer(b), directory(a)
    known = (a != "") & (b != "")
    return F.coalesce(known & ((a == b) | ((da != "") & (da == directory(b))) | ((la != "unknown") & (lb != "unknown") & (la == lb))), F.lit(False))


def is_skipped(path: Column) -> Column:
    """Whether a folder on the way is skipped or hidden."""
    folders = F.slice(segments(path), 1, F.greatest(F.size(segments(path)) - 1, F.lit(0)))
    return F.exists(folders, lambda p: p.isin(SKIPPED_FOLDERS) | p.startswith("."))


def module_path(path: Column) -> Column:
    """The dotted path an import of the file would name."""
    bare = F.regexp_replace(path, r"\.(?:py|js|ts|jsx|tsx|mjs|cjs)$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[/\\]index$", ""), r"[/\\]", "."), r"^\.+", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def test_base(path: Column) -> Column:
    """The stem without its test marks."""
    s = F.regexp_replace(file_name(path), r"\.(?:tsx|jsx|ts|js|py|mjs|cjs)$", "")
    return F.regexp_replace(F.regexp_replace(s, r"^(?:test_|Test)", ""), r"(?:_test|\.test|_spec|\.spec|Test|Spec)$", "")


def priority(path: Column) -> Column:
    """1 entry points, 2 configuration by name or at the root, 3 nested configuration and core code, 4 interfaces, 5 the rest."""
    parts = segments(F.lower(path))
    return (
        F.when(file_name(path).isin(ENTRY_NAMES), 1)
        .when(file_name(path).isin(CONFIG_NAMES), 2)
        .when(suffix(path).isin(CONFIG_ENDINGS), F.when(path.contains("/"), 3).otherwise(2))
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, CORE_FOLDERS))), 3)
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, API_FOLDERS))), 4)
        .otherwise(5)
    )


def is_included(path: Column) -> Column:
    """Whether a file belongs into a view of its repository: sources, configuration, documentation, container files."""
    return suffix(path).isin(SOURCE_ENDINGS + CONFIG_ENDINGS + DOC_ENDINGS) | file_name(path).isin(CONFIG_NAMES) | file_name(path).startswith("Dockerfile")


def tidy(path: Column) -> Column:
    """One spelling of a path: forward slashes, no leading ./ or /, no doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"/(?:\./)*/*", "/"), r"^(?:\./|/)+", "")
