"""Rendered outputs as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.render import duplicate_paths

# Fixed values.
EXTENSIONS = {"mermaid": ".mmd", "plantuml": ".puml", "markdown": ".md", "csv": ".csv", "text": ".txt"}


def placed(outputs: DataFrame, category: str, fmt: str = "mermaid") -> DataFrame:
    """(path, content) of outputs (relative_dir, name, content) below a category folder."""
    return outputs.select(F.concat_ws("/", F.lit(category), F.when(F.col("relative_dir") != "", F.col("relative_dir")), F.concat("name", F.lit(EXTENSIONS[fmt]))).alias("path"), "content")


def write_files(outputs: DataFrame, root: str) -> int:
    """Writes (path, content) rows below root from the executors; nothing is written if two rows have one path.

    A file appears under its name only when it is complete, so a task that runs twice is harmless.
    """
    twice = duplicate_paths(outputs).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate output path: {twice[0]['path']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base}/{path}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with files.open_output_stream(part, compression=None) as out:
                    out.write((content or "").encode())
                files.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return outputs.select("path", "content").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
