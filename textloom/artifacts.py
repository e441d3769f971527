"""Files that extractors need, such as model weights: checked, and installed whole or not at all.

There is no download: a path is given, and Spark distributes the file with addFile.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Artifact:
    name: str
    size: int
    sha256: str


def verify(path: str | Path, artifact: Artifact) -> bool:
    """Whether a file has the artifact's size and, if so, its checksum."""
    path = Path(path)
    if not path.is_file() or path.stat().st_size != artifact.size:
        return False
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() == artifact.sha256


def install(source: str | Path, folder: str | Path, artifact: Artifact) -> Path:
    """A verified copy in `folder`; one that is there already is kept, a broken one replaced.

    The copy is made beside its place and renamed once it is sound, so that others
    never see part of it, and whoever comes second finds an equal file.
    """
    place = Path(folder) / artifact.name
    if verify(place, artifact):
        return place
    place.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=place.parent, prefix=f".{artifact.name}-")
    try:
        with os.fdopen(handle, "wb") as out, open(source, "rb") as data:
            shutil.copyfileobj(data, out)
        if not verify(part, artifact):
            raise ValueError(f"{source} isn't {artifact.name}: size or checksum differ")
        os.replace(part, place)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return place


def distribute(spark: SparkSession, path: str | Path) -> str:
    """Make a file available to all executors; the name to ask SparkFiles for."""
    spark.sparkContext.addFile(str(path))
    return Path(path).name


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows path, size, sha256 of all files that match a pattern."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
