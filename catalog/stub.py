"""A deterministic stand-in for a speech recogniser."""

from __future__ import annotations

from collections.abc import Sequence


class StubTranscriber:
    """Says the name of the clip; clips 5, 6 and 7 of a conversation have no
    answer, an empty answer and a failure."""

    peak_memory = None
    memory_change = None

    def transcribe(self, paths: Sequence[str]) -> Sequence[str | None]:
        return [self._say(path) for path in paths]

    @staticmethod
    def _say(path: str) -> str | None:
        name = path.rsplit("/", 1)[-1]
        if name == "5.wav":
            return None
        if name == "6.wav":
            return "  "
        if name == "7.wav":
            raise RuntimeError("cannot decode")
        return f" this is {path}"
