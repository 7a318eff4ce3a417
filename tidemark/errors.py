"""What can go wrong, by code; a caller sees the code and a plain sentence, never a path or a text."""

from __future__ import annotations

#: Codes that callers rely on; fixed values.
CODES = ("NO_SOURCE", "AMBIGUOUS_SCOPE", "EXCLUDED", "INDEXING", "SEMANTIC_UNAVAILABLE", "NOT_FOUND", "LIMIT_EXCEEDED", "CORRUPT_SOURCE")


class EngineError(Exception):
    """An error with one of CODES."""

    def __init__(self, code: str, message: str = "") -> None:
        if code not in CODES:
            raise ValueError(f"no such code: {code}")
        super().__init__(message or code)
        self.code = code


def safe_code(error: BaseException, otherwise: str = "CORRUPT_SOURCE") -> str:
    """The code of any error; what is not ours has a general one, so nothing of its text gets out."""
    return error.code if isinstance(error, EngineError) else otherwise
