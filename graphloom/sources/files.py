"""Source files as tables: discovery, languages and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the discovery rules.
LANGUAGES = {
    ".py": "python",
    ".gd": "gdscript",
    ".cs": "csharp",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hxx": "cpp",
    ".java": "java",
    ".go": "go",
    ".yml": "yaml",
    ".yaml": "yaml",
}
IGNORED_FOLDERS = (".git", ".dev", ".codex", ".venv", "venv", "build", "dist", "__pycache__")
COMPOSE_NAMES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")


def language_of(path: Column | str) -> Column:
    """The language of a path's suffix, or unknown; one map lookup."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit("unknown"))


def is_ignored(path: Column | str) -> Column:
    """Whether a folder of the relative path is one to skip; a file of that name is kept."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, IGNORED_FOLDERS)))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, file) of all files below root: relative to it, and as `read_sources` names it; contents are not read.

    A root that is one file has that file's name as its path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("_metadata.file_path").alias("file"))
    base = F.lit(root.rstrip("/").removeprefix("file:").replace("//", "/"))
    plain = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "/+", "/")
    path = F.expr("CASE WHEN p = b THEN substring_index(p, '/', -1) ELSE substring(p, length(b) + 2) END")
    return files.select(plain.alias("p"), base.alias("b"), "file").select(path.alias("path"), "file")


def supported_files(files: DataFrame) -> DataFrame:
    """(path, language) of known languages outside skipped folders, by lower-case path."""
    kept = files.where(~is_ignored("path")).withColumn("language", language_of("path")).where("language != 'unknown'")
    return kept.orderBy(F.lower("path"))


def deployment_files(files: DataFrame) -> DataFrame:
    """(path, kind): Dockerfiles, compose files and other YAML."""
    name = F.lower(F.substring_index("path", "/", -1))
    kind = F.when(name.startswith("dockerfile"), F.lit("dockerfile")).when(name.isin(*COMPOSE_NAMES), F.lit("compose")).when(name.rlike(r"\.ya?ml$"), F.lit("kubernetes"))
    return files.where(~is_ignored("path")).withColumn("kind", kind).where("kind is not null").orderBy(F.lower("path"))


def read_sources(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(module_id, source): whole UTF-8 texts; the glob is pushed into the file scan."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("module_id"), F.col("value").alias("source"))
