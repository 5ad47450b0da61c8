"""Numbered errors of streams and arguments."""

from __future__ import annotations

from enum import IntEnum

# The numbers by which errors are known
_NAMES = {
    2: "CALLBACK_FAILED", 3: "DESTINATION_TOO_SMALL", 4: "NEED_MORE_DATA", 5: "INVALID_DATA", 6: "ENCODING_NOT_SUPPORTED", 7: "VALUE_NOT_SUPPORTED", 8: "COLOUR_TRANSFORM_NOT_SUPPORTED",
    9: "EXTENDED_PRESET_NOT_SUPPORTED", 10: "MARKER_START_NOT_FOUND", 11: "SOI_NOT_FOUND", 12: "BAD_SPIFF_HEADER", 13: "UNKNOWN_MARKER", 14: "UNEXPECTED_SOS", 15: "BAD_SEGMENT_SIZE", 16: "DUPLICATE_SOI",
    17: "DUPLICATE_SOF", 18: "DUPLICATE_COMPONENT", 19: "UNEXPECTED_EOI", 20: "BAD_PRESET_TYPE", 21: "SPIFF_DIRECTORY_NOT_ENDED", 22: "UNEXPECTED_RESTART", 23: "RESTART_NOT_FOUND", 24: "EOI_NOT_FOUND", 25: "UNEXPECTED_DNL",
    26: "DNL_NOT_FOUND", 27: "UNKNOWN_COMPONENT", 28: "TABLES_WITH_SPIFF", 29: "BAD_WIDTH", 30: "BAD_HEIGHT", 31: "BAD_BITS", 32: "BAD_COMPONENT_COUNT", 33: "BAD_INTERLEAVE", 34: "BAD_NEAR", 35: "BAD_PRESET",
    36: "BAD_COLOUR_TRANSFORM", 37: "BAD_TABLE_ID", 38: "BAD_TABLE_CONTINUATION", 100: "OPERATION", 101: "ARGUMENT", 102: "ARGUMENT_WIDTH", 103: "ARGUMENT_HEIGHT", 104: "ARGUMENT_BITS", 105: "ARGUMENT_COMPONENT_COUNT",
    106: "ARGUMENT_INTERLEAVE", 107: "ARGUMENT_NEAR", 108: "ARGUMENT_PRESET", 109: "ARGUMENT_COLOUR_TRANSFORM", 110: "ARGUMENT_SIZE", 111: "ARGUMENT_STRIDE", 112: "ARGUMENT_OPTIONS",
}

Code = IntEnum("Code", {name: number for number, name in _NAMES.items()})


class StreamError(ValueError):
    """Data that can't be read; `code` says why."""

    def __init__(self, code: Code, note: str = "") -> None:
        super().__init__(f"{code.name} ({int(code)}){': ' + note if note else ''}")
        self.code = code


class ArgumentError(StreamError):
    """Arguments that can't be encoded."""
