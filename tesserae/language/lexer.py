"""Tokens of the statement language."""

from __future__ import annotations

import re
from typing import NamedTuple

from .errors import StatementError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<quoted>`(?:[^`]|``)*`|"(?:[^"]|"")*")
      |(?P<string>'(?:[^']|'')*')
      |(?P<number>[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)
      |(?P<param>:[A-Za-z_][A-Za-z0-9_]*|\?)
      |(?P<word>[^\W\d]\w*)
      |(?P<op><>|!=|<=|>=|[=<>+\-*/%(),.;])""",
    re.S | re.X,
)


class Token(NamedTuple):
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise StatementError("parse_error", f"unexpected {source[at]!r} at {at}")
        kind, text = m.lastgroup, m.group()
        if kind == "quoted":
            text = text[1:-1].replace(text[0] * 2, text[0])
            if not text:
                raise StatementError("parse_error", f"empty name at {at}")
        elif kind == "string":
            text = text[1:-1].replace("''", "'")
        if kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    out.append(Token("end", "", len(source)))
    return out
