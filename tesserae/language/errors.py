"""Errors with stable codes."""

from __future__ import annotations

# Codes that callers may rely on.
CODES = frozenset(
    "invalid_request parse_error unsupported_statement validation_error not_found already_exists permission_denied revision_conflict write_conflict constraint_violation value_too_long transaction_aborted invalid_transaction_state cancelled deadline_exceeded output_truncated internal_error".split()
)
RETRYABLE = frozenset(["write_conflict", "cancelled", "deadline_exceeded"])


class StatementError(Exception):
    def __init__(self, code: str, message: str) -> None:
        assert code in CODES
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.retryable = code, message, code in RETRYABLE
