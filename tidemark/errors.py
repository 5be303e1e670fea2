"""Errors of the engine, by code."""

# Codes and their reasons.
REASONS = {
    401: "no such point", 404: "no such stream", 406: "stream exists", 407: "invalid collection", 408: "invalid key",
    409: "invalid value", 413: "invalid time range", 414: "insert too big", 415: "invalid point width",
    421: "wrong arguments", 423: "annotation version mismatch", 425: "bad value", 427: "invalid versions",
    429: "reused uuid", 430: "concurrent modification", 431: "obliterate disabled",
}


class EngineError(Exception):
    def __init__(self, code: int, detail: str = "") -> None:
        self.code, self.reason = code, REASONS[code]
        super().__init__(f"[{code}] {self.reason}" + (f": {detail}" if detail else ""))
