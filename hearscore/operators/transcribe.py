"""Slot for a speech recogniser: one call per batch of clips, with its cost."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearscore.functions.text import hypothesis_or_sentinel
from hearscore.schema import CACHE


class Transcriber(Protocol):
    """``transcribe`` takes a list of paths and gives one text or ``None``
    per path; ``peak_memory`` and ``memory_change`` may report bytes."""

    def transcribe(self, paths: Sequence[str]) -> Sequence[str | None]: ...


_RAW = T.StructType(
    [
        T.StructField("__raw", T.StringType()),
        T.StructField("__failed", T.BooleanType()),
        T.StructField("elapsed_time_seconds", T.DoubleType()),
        T.StructField("peak_vram_bytes", T.LongType()),
        T.StructField("vram_diff_bytes", T.LongType()),
    ]
)


def _attempt(model: Transcriber, paths: Sequence[str]) -> list[tuple[str | None, bool]]:
    """Texts of some clips and whether each failed.  Clips without an answer
    are asked for once more; after an exception each clip is tried alone, and
    only that which raises again has failed."""
    try:
        texts = list(model.transcribe(paths))
        if len(texts) != len(paths):
            raise ValueError(f"{len(texts)} texts for {len(paths)} clips")
        again = [i for i, text in enumerate(texts) if text is None]
        if again:
            for i, text in zip(again, model.transcribe([paths[i] for i in again]), strict=True):
                texts[i] = text
        return [(text, False) for text in texts]
    except Exception:
        if len(paths) == 1:
            return [(None, True)]
        return [one for path in paths for one in _attempt(model, [path])]


def stage_profile(spark: SparkSession, profile: ResourceProfile | None) -> ResourceProfile | None:
    """``profile`` if this master can give a stage its own resources, else None
    and a warning: local ones can't, and others need dynamic allocation unless
    the profile asks for nothing of executors."""
    if profile is None:
        return None
    master = spark.sparkContext.master
    dynamic = spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true"
    if master.startswith(("yarn", "k8s", "spark:")) and (dynamic or not profile.executorResources):
        return profile
    warnings.warn(f"{master}: the transcription stage runs without its resource profile", stacklevel=2)
    return None


def transcribe_batch(
    pending: DataFrame,
    load: Callable[[], Transcriber],
    *,
    exists: str | None = None,
    tasks: int | None = None,
    batch_size: int = 16,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run the transcriber over pending clips, ``batch_size`` at a time; the
    time of a call is divided over its clips.

    ``load`` runs once per Python worker task, and only when there is a clip.
    ``exists`` names a BOOLEAN column; clips without a file get ``''``.
    ``profile`` names the resources of its stage, such as executors with a GPU,
    so that the stages before and after it don't hold them (``stage_profile``).
    Returns the input plus ``asr_hyp`` and the cost columns.  Clips that
    failed or have no file carry ``''`` and are not meant to be cached
    (``cacheable``).
    """
    schema = T.StructType([*pending.schema.fields, *_RAW.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Transcriber | None = None
        for batch in batches:
            rows: list[tuple] = [(None, True, None, None, None)] * len(batch)
            present = [True] * len(batch) if exists is None else batch[exists].fillna(False)
            paths = batch["audio_path"].tolist()
            asked = [i for i, there in enumerate(present) if there and paths[i]]
            for start in range(0, len(asked), batch_size):
                some = asked[start : start + batch_size]
                if model is None:
                    model = load()
                started = time.time()
                answers = _attempt(model, [paths[i] for i in some])
                each = round((time.time() - started) / len(some), 3)
                memory = getattr(model, "peak_memory", None), getattr(model, "memory_change", None)
                for i, answer in zip(some, answers, strict=True):
                    rows[i] = (*answer, each, *memory)
            made = pd.DataFrame(rows, columns=_RAW.names, index=batch.index).astype(
                {"peak_vram_bytes": "Int64", "vram_diff_bytes": "Int64", "__failed": "bool"}
            )
            yield pd.concat([batch, made], axis=1)

    rows = pending.repartition(tasks) if tasks else pending
    raw = rows.mapInPandas(run, schema, profile=stage_profile(pending.sparkSession, profile))
    hyp = F.when(F.col("__failed"), F.lit("")).otherwise(hypothesis_or_sentinel("__raw"))
    return raw.withColumn("asr_hyp", hyp).drop("__raw", "__failed")


def cache_rows(transcribed: DataFrame, day: str | None = None) -> DataFrame:
    """Rows to append to the hypothesis cache: clips with an answer, dated."""
    date = F.lit(day) if day else F.date_format(F.current_date(), "yyyyMMdd")
    kept = transcribed.filter(F.col("asr_hyp") != "")
    return kept.withColumn("hyp_gen_date", date).select(*CACHE.names)
