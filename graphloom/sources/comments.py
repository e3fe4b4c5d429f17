"""Comment candidates of source lines, and sources with comments inserted, as column expressions.

Each language is a list of line rules in order of precedence; a line that follows a
comment (the last line before it that isn't blank) is left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators.evaluate import previous_content

#: language: [(target, pattern with one group for the name)], and what starts a comment.  Patterns see one line.
RULES: dict[str, tuple[list[tuple[str, str]], str]] = {
    "python": ([("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(?!__)(\w+)")], "#"),
    "gdscript": ([("class", r"^\s*(?:class_name|class)\s+(\w+)"), ("signal", r"^\s*signal\s+(\w+)"), ("field", r"^\s*@(?:export|onready)\S*\s+var\s+(\w+)"), ("function", r"^\s*(?:static\s+)?func\s+(\w+)")], "#"),
    "csharp": ([("class", r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial)\s+)*(?:class|struct|interface|enum|record)\s+(\w+)"), ("method", r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\([^;]*$")], "//"),
    "java": ([("class", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("field", r"^\s*(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*(?:=.*)?;"), ("method", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\],.?]+\s+(\w+)\s*\([^;]*\{\s*$")], "//"),
    "cpp": ([("class", r"^\s*(?:class|struct|enum(?:\s+class)?)\s+(\w+)\s*[^;]*$"), ("field", r"^\s+(?:const\s+|static\s+)*[\w:<>*&]+\s+(\w+)\s*(?:=[^;()]*)?;\s*$"), ("method", r"^\s*(?:[\w:<>*&~]+\s+)+[*&]?([\w:~]+)\s*\([^;]*\)\s*(?:const\s*)?(?:\{.*)?$")], "//"),
    "go": ([("class", r"^type\s+(\w+)\s+(?:struct|interface)\b"), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("field", r"^\s+(\w+)\s+[\w\[\]*.]+\s*$")], "//"),
}


def lines_of(sources: DataFrame) -> DataFrame:
    """(module_id, line, text) of sources (module_id, source)."""
    return sources.select("module_id", F.posexplode(F.split("source", "\r?\n")).alias("p", "text")).select("module_id", (F.col("p") + 1).alias("line"), "text")


def describe(target: Column, name: Column) -> Column:
    """A sentence by the prefix of the name."""
    words = names.words_b(name)
    rest = F.trim(F.regexp_replace(words, r"^\S+", ""))
    rest = F.when(rest == "", words).otherwise(rest)
    head = F.split(words, " ")[0]
    return (
        F.when(target == "class", F.concat(F.lit("Represents "), words, F.lit(".")))
        .when(head.isin("is", "has", "can", "should"), F.concat(F.lit("Checks "), rest, F.lit(".")))
        .when(head.isin("get", "load", "fetch", "read"), F.concat(F.lit("Retrieves "), rest, F.lit(".")))
        .otherwise(F.concat(F.lit("Performs "), words, F.lit(".")))
    )


def candidates(sources: DataFrame, language: str) -> DataFrame:
    """(module_id, line, indent, target, name, comment): declarations without a comment before them."""
    if language not in RULES:
        raise ValueError(f"unsupported language: {language}")
    rules, mark = RULES[language]
    lines = previous_content(lines_of(sources), ["module_id"], "line", "text").where(~F.coalesce(F.col("previous"), F.lit("")).startswith(mark))
    target, name = F.lit(None).cast("string"), F.lit("")
    for kind, pattern in reversed(rules):
        hit = F.regexp_extract("text", pattern, 1)
        target, name = F.when(hit != "", F.lit(kind)).otherwise(target), F.when(hit != "", hit).otherwise(name)
    rows = lines.select("module_id", "line", F.regexp_extract("text", r"^(\s*)", 1).alias("indent"), target.alias("target"), name.alias("name")).where("target is not null")
    return rows.withColumn("comment", F.concat(F.lit(mark + " "), describe(F.col("target"), F.col("name"))))


def insert(sources: DataFrame, found: DataFrame, keys: Sequence[str] = ("module_id",)) -> DataFrame:
    """(module_id, source): each comment on a line of its own above its declaration, at the same indent; line ends are kept."""
    rows = lines_of(sources).select("module_id", "line", F.lit(1).alias("o"), "text")
    rows = rows.unionByName(found.select("module_id", "line", F.lit(0).alias("o"), F.concat("indent", "comment").alias("text")))
    folded = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "o", "text"))), lambda r: r["text"]).alias("t"))
    ends = sources.select("module_id", F.when(F.col("source").contains("\r\n"), F.lit("\r\n")).otherwise(F.lit("\n")).alias("end"))
    return folded.join(ends, "module_id").select("module_id", F.array_join("t", "\u0000").alias("s"), "end").select("module_id", F.replace("s", F.lit("\u0000"), F.col("end")).alias("source"))
