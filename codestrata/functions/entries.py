"""What marks a function as an entry point: patterns on names, decorators and files."""

from __future__ import annotations

import re

# Names of entry points, of callbacks and of asynchronous generators.
NAMES = [r"^main$", r"^__init__$", r"^test_", r"_handler$", r"_route$", r"_endpoint$", r"_view$", r"^__[a-z_]+__$"]
CALLBACKS = [r"^on_[a-z_]+$", r"^on[A-Z]", r"^handle_[a-z_]+$", r"^handle[A-Z]", r"_callback$", r"_hook$", r"_listener$", r"_factory$", r"_strategy$", r"^toggle[A-Z]", r"^format[A-Z]", r"^get[A-Z].*Color$", r"^render[A-Z]", r"^use[A-Z]"]
GENERATORS = [r"^subscribe_", r"^stream_", r"_stream$", r"_generator$"]
# Decorators that register a function.
DECORATORS = [
    r"^(app|router)\.(get|post|put|patch|delete|options|head|trace|websocket)$", r"^(get|post|put|patch|delete|options|head)$", r"^(celery_app|celery|app)\.(task|shared_task)$", r"^(task|shared_task)$",
    r"^pytest\.(fixture|mark\..+)$", r"^fixture$", r"^(model_validator|field_validator|validator|root_validator)$", r"^(computed_field|field_serializer)$", r"^(event\.listens_for|listens_for)$",
    r"^(click\.)?(command|group|option|argument)$", r"^(app|blueprint)\.(route|before_request|after_request|errorhandler)$", r"^(login_required|permission_required|require_http_methods)$",
    r"^(on_event|event_handler|callback|subscriber)$", r"^(given|composite|example)$", r"^(property|staticmethod|classmethod|abstractmethod)$", r"^(dataclass|attrs|define)$",
    r"^(contextmanager|asynccontextmanager)$", r"^(cache|lru_cache|cached_property)$", r"^(asyncio\.coroutine|coroutine)$",
]
# Files whose functions are all entry points; files of interfaces and of workers.
FILES = [
    r"test_[^/]+\.py$", r"[^/]+_test\.py$", r"conftest\.py$", r"[^/]+\.test\.[jt]sx?$", r"[^/]+\.spec\.[jt]sx?$", r"__tests__/.*\.[jt]sx?$", r"alembic/versions/", r"migrations/", r"__main__\.py$", r"cli\.py$",
    r"commands?\.py$", r"scripts/[^/]+\.py$", r"jest\.config\.[jt]s$", r"vitest\.config\.[jt]s$", r"cypress/.*\.[jt]sx?$", r"e2e/.*\.[jt]sx?$",
]
API_FILES = [r"api/v\d+/[^/]+\.py$", r"routes?/[^/]+\.py$", r"endpoints?/[^/]+\.py$", r"views?/[^/]+\.py$"]
WORKER_FILES = [r"workers?/[^/]+\.py$", r"tasks?/[^/]+\.py$", r"celery_tasks?\.py$"]

_any = lambda patterns: re.compile("|".join(f"(?:{p})" for p in patterns)).search
_name, _callback, _generator, _decorator, _file, _served = _any(NAMES), _any(CALLBACKS), _any(GENERATORS), _any(DECORATORS), _any(FILES), _any(API_FILES + WORKER_FILES)


def python_entry(path: str, name: str, decorators: list[str], public_method: bool) -> bool:
    """Whether a Python function is an entry point: by file, name, decorator, as a public method, or decorated in a served file."""
    served = bool(decorators) and not name.startswith("_") and bool(_served(path))
    return bool(_file(path) or _name(name) or _callback(name) or _generator(name) or any(_decorator(d) for d in decorators)) or public_method or served


def script_entry(path: str, name: str, exported: bool) -> bool:
    """Whether a function of a script is an entry point: by file, name, or as an export."""
    return exported or bool(_file(path) or _name(name) or _callback(name))
