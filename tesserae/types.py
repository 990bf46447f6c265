"""The five value types and their checks."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from typing import Any

from .language.errors import StatementError

KINDS = ("INTEGER", "BOOLEAN", "TIMESTAMP", "TEXT", "RELATION_ID")
SPARK = {"INTEGER": "bigint", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "TEXT": "string", "RELATION_ID": "string"}
DEFAULT_TEXT = 1200
_RELATION_ID = re.compile(r"row_[A-Za-z0-9_-]+")


def timestamp(value: Any) -> datetime:
    """RFC 3339 text or a datetime as UTC."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError as e:
            raise StatementError("validation_error", f"{value!r} is no timestamp") from e
    if not isinstance(value, datetime) or value.tzinfo is None:
        raise StatementError("validation_error", "a timestamp needs a zone")
    return value.astimezone(timezone.utc)


def check(value: Any, kind: str, size: int | None = None, nullable: bool = True) -> Any:
    """The value as its column stores it; nothing is converted between types or cut."""
    if value is None:
        if not nullable:
            raise StatementError("constraint_violation", "null isn't allowed")
        return None
    if kind == "INTEGER":
        if isinstance(value, bool) or not isinstance(value, int):
            raise StatementError("validation_error", f"{value!r} is no integer")
        if not -(1 << 63) <= value < 1 << 63:
            raise StatementError("constraint_violation", "integer overflow")
    elif kind == "BOOLEAN":
        if not isinstance(value, bool):
            raise StatementError("validation_error", f"{value!r} is no boolean")
    elif kind == "TIMESTAMP":
        return timestamp(value)
    else:
        if not isinstance(value, str):
            raise StatementError("validation_error", f"{value!r} is no text")
        if kind == "RELATION_ID":
            if not _RELATION_ID.fullmatch(value):
                raise StatementError("validation_error", f"{value!r} is no row id")
        elif len(value) > (size or DEFAULT_TEXT):
            raise StatementError("value_too_long", f"{len(value)} characters, {size or DEFAULT_TEXT} allowed")
    return value


def encode(value: Any) -> str | None:
    """Text form in which a value is stored."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    return str(value)


def decode(value: str | None, kind: str) -> Any:
    if value is None:
        return None
    if kind == "INTEGER":
        return int(value)
    if kind == "BOOLEAN":
        return value == "true"
    if kind == "TIMESTAMP":
        return datetime.strptime(value, "%Y-%m-%d %H:%M:%S.%f").replace(tzinfo=timezone.utc)
    return value
