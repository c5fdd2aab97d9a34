"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()

AUDIO = _struct(("path", _S), ("array", T.ArrayType(T.FloatType())), ("sampling_rate", _I))

SAMPLE = _struct(
    ("dataset", _S),
    ("subset", _S),
    ("split", _S),
    ("sample_idx", _L),
    ("audio_path", _S),
    ("text", _S),
)

CACHE_VALUE = _struct(
    ("asr_hyp", _S),
    ("provider", _S),
    ("model", _S),
    ("version", _S),
    ("codename", _S),
    ("hyp_gen_date", _S),
    ("elapsed_time_seconds", _D),
    ("peak_vram_bytes", _L),
    ("vram_diff_bytes", _L),
)

# One line of a stored cache: {audio path: {version: value}}.
CACHE_LINE = T.MapType(_S, T.MapType(_S, CACHE_VALUE))

# The same, one row per (dataset, codename, audio path, version).
CACHE = _struct(
    ("dataset", _S),
    ("codename", _S),
    ("audio_path", _S),
    ("version", _S),
    ("asr_hyp", _S),
    ("provider", _S),
    ("model", _S),
    ("hyp_gen_date", _S),
    ("elapsed_time_seconds", _D),
    ("peak_vram_bytes", _L),
    ("vram_diff_bytes", _L),
)

CACHE_COSTS = ["elapsed_time_seconds", "peak_vram_bytes", "vram_diff_bytes"]
CACHE_KEY = ["dataset", "codename", "audio_path", "version"]

RESOURCES = _struct(
    ("resources_gen_time_seconds", _D),
    ("resources_peak_vram_bytes", _L),
    ("resources_vram_diff_bytes", _L),
)

EVAL_INPUT = T.StructType(
    [
        *SAMPLE.fields[:5],
        *_struct(("provider", _S), ("model", _S), ("version", _S), ("codename", _S)).fields,
        *_struct(("text", _S), ("hypothesis", _S)).fields,
        *RESOURCES.fields,
    ]
)

# Rows that are scored one after the other: the running values restart here.
RUN_KEYS = ["dataset", "subset", "split", "system", "version", "norm_type"]
SUMMARY_KEYS = ["dataset", "subset", "split", "norm_type", "system"]
SPLIT_KEYS = ["dataset", "subset", "split"]

SPLITS = ("train", "validation", "test")
