"""The text layer of PDF files: objects, object streams, page tree, Flate streams and ToUnicode maps. Files without text, and encrypted ones, are errors."""

from __future__ import annotations

import re
import zlib
from typing import Any

MOST_BYTES = 64_000_000
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(<<|>>|\[|\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%{}]*|[-+]?\d*\.?\d+|[A-Za-z'\"*][A-Za-z0-9'\"*]*|\(|.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(int):
    pass


class Word(str):
    pass


class Reader:
    """Reads PDF values one after the other."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        m = _TOKEN.match(self.data, self.at)
        if not m or not m[1].strip():
            return None
        self.at = m.end()
        if m[1] == b"(":  # nested parentheses
            depth, start = 1, self.at
            while depth and self.at < len(self.data):
                c = self.data[self.at : self.at + 1]
                self.at += 2 if c == b"\\" else 1
                depth += (c == b"(") - (c == b")")
            return b"(" + self.data[start : self.at]
        return m[1]

    def value(self) -> Any:
        """The next value; Word for operators, None at the end."""
        t = self.token()
        if t is None:
            return None
        if t == b"<<":
            items = self.until(">>")
            return {str(items[k]): items[k + 1] for k in range(0, len(items) - 1, 2)}
        if t == b"[":
            return self.until("]")
        if t[:1] == b"(":
            return unescaped(t[1:-1])
        if t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), t[1:]).decode("latin-1"))
        if re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            if t.isdigit() and (m := re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(self.data, self.at)):
                self.at = m.end()
                return Ref(int(t))
            return float(t) if b"." in t else int(t)
        return Word(t.decode("latin-1"))

    def until(self, end: str) -> list:
        out: list = []
        while True:
            v = self.value()
            if v is None or isinstance(v, Word) and v == end:
                return out
            out.append(v)


def unescaped(text: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, text, flags=re.S)


class Pdf:
    def __init__(self, data: bytes) -> None:
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("this is no PDF")
        self.objects: dict[int, Any] = {}
        self.streams: dict[int, tuple[dict, bytes]] = {}
        for m in _OBJECT.finditer(data):
            reader = Reader(data, m.end())
            value = reader.value()
            self.objects[int(m[1])] = value
            s = re.compile(rb"\s*stream\r?\n").match(data, reader.at)
            if s and isinstance(value, dict):
                size = value.get("Length")
                end = s.end() + size if isinstance(size, int) and not isinstance(size, Ref) and data[s.end() + size : s.end() + size + 20].lstrip().startswith(b"endstream") else data.find(b"endstream", s.end())
                self.streams[int(m[1])] = (value, data[s.end() : end])
        if any("Encrypt" in (Reader(data, m.end()).value() or {}) for m in re.finditer(rb"trailer", data)):
            raise ValueError("encrypted files aren't read")
        for n, (head, _) in list(self.streams.items()):
            if head.get("Type") == "ObjStm":
                body = self.stream(n)
                reader = Reader(body)
                numbers = [reader.value() for _ in range(2 * int(self.get(head["N"])))]
                for k in range(0, len(numbers), 2):
                    self.objects.setdefault(numbers[k], Reader(body, int(self.get(head["First"])) + numbers[k + 1]).value())

    def get(self, value: Any) -> Any:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def stream(self, n: int) -> bytes:
        head, raw = self.streams[n]
        filters = self.get(head.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(f) not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {f} isn't read")
            z = zlib.decompressobj()
            raw = z.decompress(raw, MOST_BYTES)
            if z.unconsumed_tail:
                raise ValueError(f"a stream is larger than {MOST_BYTES} bytes")
        return raw

    def pages(self) -> list[dict]:
        out, seen = [], set()

        def walk(ref: Any, inherited: dict) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and int(ref) in seen:
                return
            if isinstance(ref, Ref):
                seen.add(int(ref))
            node = {"Resources": inherited.get("Resources")} | node
            if node.get("Type") == "Page":
                out.append(node)
            for kid in self.get(node.get("Kids")) or []:
                walk(kid, node)

        for o in self.objects.values():
            if isinstance(o, dict) and o.get("Type") == "Catalog":
                walk(o.get("Pages"), {})
        return out or [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Page"]

    def text(self, page: dict) -> str:
        fonts = {}
        resources = self.get(page.get("Resources")) or {}
        for name, ref in (self.get(resources.get("Font")) or {}).items():
            font = self.get(ref) or {}
            to = font.get("ToUnicode")
            fonts[name] = to_unicode(self.stream(int(to))) if isinstance(to, Ref) and int(to) in self.streams else (1, None)
        contents = page.get("Contents")
        parts = self.get(contents) if isinstance(self.get(contents), list) else [contents]
        return page_text(b"\n".join(self.stream(int(p)) for p in parts if isinstance(p, Ref) and int(p) in self.streams), fonts)


def to_unicode(cmap: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, code -> text)."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    reader, width, stack = Reader(cmap), 1, []
    while (v := reader.value()) is not None:
        if not isinstance(v, Word):
            stack.append(v)
            continue
        hexes = [x for x in stack if isinstance(x, (bytes, list))]
        if v == "endcodespacerange" and hexes:
            width = max(1, len(hexes[0]))
        elif v == "endbfchar":
            out |= {int.from_bytes(a): text(b) for a, b in zip(hexes[::2], hexes[1::2])}
        elif v == "endbfrange":
            for a, b, to in zip(hexes[::3], hexes[1::3], hexes[2::3]):
                first, last = int.from_bytes(a), int.from_bytes(b)
                for k in range(first, min(last, first + 65_535) + 1):
                    if isinstance(to, list):
                        if k - first < len(to):
                            out[k] = text(to[k - first])
                    else:
                        out[k] = text(to[:-2]) + chr(int.from_bytes(to[-2:]) + k - first)
        stack = []
    return width, out


def page_text(content: bytes, fonts: dict) -> str:
    out: list[str] = []
    font: tuple[int, dict | None] = (1, None)

    def show(raw: Any) -> None:
        if isinstance(raw, bytes):
            width, known = font
            if known is None:
                out.append(raw.decode("cp1252", "replace"))
            else:
                out.append("".join(known.get(int.from_bytes(raw[k : k + width]), "") for k in range(0, len(raw), width)))

    reader, stack = Reader(content), []
    while (v := reader.value()) is not None:
        if not isinstance(v, Word):
            stack.append(v)
            continue
        if v == "Tf" and len(stack) >= 2:
            font = fonts.get(str(stack[-2]), (1, None))
        elif v in ("T*", "'", '"', "ET") or v in ("Td", "TD") and len(stack) >= 2 and stack[-1] or v == "Tm":
            out.append("\n")
        elif v in ("Td", "TD"):
            out.append(" ")
        if v in ("Tj", "'", '"') and stack:
            show(stack[-1])
        elif v == "TJ" and stack and isinstance(stack[-1], list):
            for x in stack[-1]:
                if isinstance(x, (int, float)) and x < -200:
                    out.append(" ")
                show(x)
        stack = []
    return "\n".join(line for line in (" ".join(x.split()) for x in "".join(out).split("\n")) if line)


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page; without any the file has no text layer."""
    pdf = Pdf(data)
    out = [pdf.text(p) for p in pdf.pages()]
    if not any(out):
        raise ValueError("no text layer")
    return out
