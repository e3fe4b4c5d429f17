"""Naming rules as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the naming rules.
HANDLER_PREFIXES = ("on_", "handle_", "handle", "do_")
HANDLER_SUFFIXES = ("_clicked", "_click", "_pressed", "_press", "_triggered", "_changed")
SERVICE_KINDS = (
    ("database", ("postgres", "mysql", "mariadb", "mongo", "sqlite")),
    ("cache", ("redis", "memcached")),
    ("message-queue", ("rabbitmq", "kafka", "nats", "activemq")),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qualified_name(parent: Column | str, name: Column | str) -> Column:
    """parent.name, or the name alone for a null or empty parent."""
    return F.when(F.coalesce(_col(parent), F.lit("")) != "", F.concat(parent, F.lit("."), name)).otherwise(_col(name))


def last_segment(name: Column | str) -> Column:
    return F.substring_index(name, ".", -1)


def owner(name: Column | str) -> Column:
    """The name without its last dotted segment; a name without dots is its own owner."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def safe_name(value: Column | str, fallback: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_.-]+", "_"), "^[_.-]+|[_.-]+$", "")
    return F.when(clean == "", F.lit(fallback)).otherwise(clean)


def stable_output_name(prefix: str, logical: Column | str, fallback: str = "diagram") -> Column:
    """prefix, ten hex digits of the name's SHA-256, and at most 80 readable characters."""
    clean = F.regexp_replace(F.regexp_replace(logical, "[^A-Za-z0-9_-]+", "_"), "^[_-]+|[_-]+$", "")
    short = F.regexp_replace(F.substring(clean, 1, 80), "[_-]+$", "")
    readable = F.when(short == "", F.lit(fallback)).otherwise(short)
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(_col(logical).cast("binary"), 256), 1, 10), F.lit("_"), readable)


def series_directory(root: Column | str) -> Column:
    return stable_output_name("series", root, "series")


def words_a(name: Column | str) -> Column:
    """Lower-case words split at lower-to-upper steps and underscores, empty ones dropped."""
    parts = F.split(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "_")
    return F.filter(F.transform(parts, F.lower), lambda w: w != "")


def words_b(name: Column | str) -> Column:
    """The same words as one text with single spaces between the splits."""
    return F.array_join(F.transform(F.split(name, "(?<=[a-z0-9])(?=[A-Z])|_+"), F.lower), " ")


def humanize_handler(handler: Column | str) -> Column:
    """A handler as a sentence: one known prefix and suffix off, underscores to spaces, capitalised."""
    name = last_segment(handler)
    name = F.regexp_replace(name, f"^(?:{'|'.join(HANDLER_PREFIXES)})", "")
    name = F.regexp_replace(name, f"(?:{'|'.join(HANDLER_SUFFIXES)})$", "")
    text = F.array_join(F.filter(F.split(name, "_"), lambda w: w != ""), " ")
    return F.when(text == "", F.lit("User action")).otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30))))


def use_case_name(label: Column | str, handler: Column | str) -> Column:
    return F.when(F.trim(F.coalesce(_col(label), F.lit(""))) != "", F.trim(_col(label))).otherwise(humanize_handler(handler))


def resolve_relative(module: Column | str, is_package: Column | str, reference: Column | str) -> Column:
    """An import with leading dots as an absolute name; too many dots leave only what follows them."""
    ref = _col(reference)
    tail = F.regexp_replace(ref, r"^\.+", "")
    up = F.greatest(F.length(ref) - F.length(tail) - 1, F.lit(0)) + F.when(_col(is_package), F.lit(0)).otherwise(F.lit(1))
    parts = F.split(module, r"\.")
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0)))
    return F.array_join(F.concat(base, F.filter(F.split(tail, r"\."), lambda p: p != "")), ".")


def object_key(scope: Column | str, name: Column | str) -> Column:
    return F.concat(F.coalesce(_col(scope), F.lit("<module>")), F.lit(":"), name)


def classify_service(name: Column | str, image: Column | str) -> Column:
    """The kind whose marker occurs in name or image; the first kind wins."""
    text = F.lower(F.concat_ws(" ", name, image))
    kind = F.lit("service")
    for label, markers in reversed(SERVICE_KINDS):
        kind = F.when(text.rlike("|".join(markers)), F.lit(label)).otherwise(kind)
    return kind


def module_name(path: Column | str, root_name: str) -> Column:
    """A path below the root as a dotted module; __init__ stands for its folder."""
    dotted = F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"(?:^|/)__init__$", ""), F.lit("/"), F.lit("."))
    return F.when(dotted == "", F.lit(root_name)).otherwise(dotted)


def component_name(path: Column | str, root_name: str) -> Column:
    """The folder of a file; for a file in the root, its stem, or the root's name for __init__.py."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    folder = F.replace(F.regexp_replace(path, "/[^/]*$", ""), F.lit("/"), F.lit("."))
    return F.when(F.instr(path, "/") > 0, folder).when(_col(path) == "__init__.py", F.lit(root_name)).otherwise(stem)


def responsibility(name: Column | str, docstring: Column | str, method_names: Column | str) -> Column:
    """The first docstring line, else a sentence by the family of the methods (lower-case names)."""
    words = F.array_join(words_a(name), " ")
    has = lambda *names: F.arrays_overlap(_col(method_names), F.array(*map(F.lit, names)))
    rule = (
        F.when(has("load", "read", "save", "write"), F.concat(F.lit("Handles "), words, F.lit(" data input and output.")))
        .when(has("update", "process", "run", "execute"), F.concat(F.lit("Coordinates "), words, F.lit(" processing.")))
        .when(has("validate", "check", "evaluate"), F.concat(F.lit("Validates or evaluates "), words, F.lit(" state.")))
        .otherwise(F.concat(F.lit("Manages "), words, F.lit(" state and behavior.")))
    )
    return F.when(F.coalesce(_col(docstring), F.lit("")) != "", F.trim(F.regexp_substr(docstring, F.lit(r"\A[^\n\r]*")))).otherwise(rule)


def path_hint(token: Column | str) -> Column:
    """A command token as a project path, or null; see PATH_SUFFIXES and PROJECT_FOLDERS."""
    raw = F.regexp_replace(F.regexp_replace(F.trim(_col(token)), "^[\"']+|[\"']+$", ""), "^[(),;]+|[(),;]+$", "")
    odd = (raw == "") | raw.rlike(r"^(?:-|\$)") | raw.contains("://")
    path = F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), r"^\./", ""), "/+$", "")
    path = F.when(path == "", F.lit(".")).otherwise(path)
    low = F.lower(path)
    good = (
        (path == ".") | raw.rlike(r"^\.\.?/") | low.isin(*PROJECT_FOLDERS) | (path.contains("/") & ~path.contains(":"))
        | low.rlike(rf"[^/](?:{'|'.join(x.replace('.', chr(92) + '.') for x in PATH_SUFFIXES)})$") | path.rlike(r"[*?\[]")
    )
    return F.when(~odd & good, path)


# Fixed values of the path hints.
PATH_SUFFIXES = (".py", ".pyi", ".cs", ".csproj", ".sln", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx", ".gd", ".java", ".go", ".yml", ".yaml", ".toml", ".json", ".sh", ".bat", ".ps1")
PROJECT_FOLDERS = ("src", "source", "test", "tests", "app", "apps", "lib", "libs", "script", "scripts", "tool", "tools")


def command_paths(command: Column | str) -> Column:
    """The distinct path hints of a command, in order."""
    tokens = F.regexp_extract_all(command, F.lit("\"[^\"]*\"|'[^']*'|\\S+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(tokens, path_hint), lambda x: x.isNotNull()))


def references(text: Column | str, scope: str) -> Column:
    """Sorted distinct names of `scope.X` and `scope['X']` in a text."""
    dotted = F.regexp_extract_all(text, F.lit(rf"\b{scope}\.([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    quoted = F.regexp_extract_all(text, F.lit(rf"\b{scope}\[['\"]([^'\"]+)['\"]\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(dotted, quoted)))
