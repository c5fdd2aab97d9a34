"""Durations of WAV data."""

from __future__ import annotations

import wave
from typing import BinaryIO


def wav_seconds(file: BinaryIO) -> float | None:
    """Seconds by the header of a seekable file, two decimals; None if it does
    not hold the header of a PCM WAV file.  Chunks before the samples are
    skipped, and the samples are not read."""
    try:
        with wave.open(file) as clip:
            return round(clip.getnframes() / clip.getframerate(), 2)
    except (wave.Error, EOFError, ZeroDivisionError):
        return None
