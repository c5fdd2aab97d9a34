"""Audio files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearscore.functions.audio import wav_seconds

_SCHEME = r"^[a-z][a-z0-9+.-]*:/*(?=/)"


def list_files(
    spark: SparkSession, path: str | Sequence[str], pattern: str | None = None
) -> DataFrame:
    """``path, length`` of the files below ``path``; contents are not read."""
    return _scan(spark, path, pattern).select(_plain_path(), "length")


def audio_manifest(
    spark: SparkSession, path: str | Sequence[str], pattern: str | None = "*.wav"
) -> DataFrame:
    """``path, audio_duration`` of the WAV files below ``path``; 0.0 if a file
    can't be read as one.

    Tasks get paths only and step through the chunk headers of each file: no
    samples are read, however long a file is and however many chunks come
    first.  The store must be one that ``pyarrow.fs`` opens.
    """
    return list_files(spark, path, pattern).mapInPandas(_measured, "path string, audio_duration double")


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seconds = [_seconds(path) for path in batch["path"]]
        yield pd.DataFrame({"path": batch["path"], "audio_duration": seconds})


def _seconds(path: str) -> float:
    store, inner = FileSystem.from_uri(path if re.match(_SCHEME, path) else f"file://{quote(path)}")
    try:
        with store.open_input_file(inner) as file:
            return wav_seconds(file) or 0.0
    except OSError:
        return 0.0


def _scan(spark: SparkSession, path: str | Sequence[str], pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path if isinstance(path, str) else list(path))


def _plain_path():
    """Local files without their scheme, as corpora refer to them."""
    return F.when(
        F.startswith("path", F.lit("file:")), F.regexp_replace("path", _SCHEME, "")
    ).otherwise(F.col("path")).alias("path")
