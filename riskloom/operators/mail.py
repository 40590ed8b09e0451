"""Raw messages to rows: headers, text parts, attachments, text of attached documents, nested messages.

Nesting is flattened: a message inside a message is a row of its own with parent and depth. Limits are those of the
semantics: 200 parts, depth 3, 20 nested messages in all; what goes beyond sets ``incomplete``."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from email import message_from_bytes, policy
from email.message import EmailMessage
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import html as H

#: Limits that are part of the results.
MAX_PARTS, MAX_DEPTH, MAX_NESTED, RECEIVED = 200, 3, 20, 30
PDF_BYTES, PDF_INFLATED, PDF_STREAMS, PDF_LINKS, TEXT_CHARS = 2 << 20, 4 << 20, 64, 50, 20_000
DOCX_BYTES, DOCX_PART = 10 << 20, 2 << 20
ATTACHMENT = "struct<filename:string,content_type:string,text:string,links:array<string>,status:string>"
SCHEMA = f"node int, parent int, depth int, sender string, reply_to string, return_path string, recipients array<string>, subject string, received array<string>, auth_results array<string>, plain string, html_text string, links array<struct<label:string,destination:string>>, attachments array<{ATTACHMENT}>, incomplete boolean"
NAMES = [x.split(" ")[0] for x in SCHEMA.replace("array<struct<label:string,destination:string>>", "x").replace(f"array<{ATTACHMENT}>", "x").split(", ")]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
URI = re.compile(rb"/URI\s*\(((?:\\.|[^\\()])*)\)")
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\b(?:Td|TD|T\*|Tm|Tj|TJ|ET)\b|['\"]", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\(\d{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data.decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def pdf(data: bytes) -> tuple[str, list[str], str]:
    """(text, link targets, status) of a PDF's literal and hexadecimal strings: raw and inflated streams."""
    if len(data) > PDF_BYTES:
        return "", [], "oversized"
    bodies, room, status = [data], PDF_INFLATED, "ok"
    for k, m in enumerate(STREAM.finditer(data)):
        if k >= PDF_STREAMS or room <= 0:
            status = "partial"
            break
        try:
            body = zlib.decompressobj().decompress(m[1], room)
        except zlib.error:
            continue
        room -= len(body)
        bodies.append(body)
    links = dict.fromkeys(_literal(b"(" + m[1] + b")") for b in bodies for m in URI.finditer(b))
    lines: list[str] = []
    for body in bodies[1:]:
        shown: list[str] = []
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            for token in SHOW.findall(block):
                if token[:1] in b"(<":
                    shown.append(_literal(token))
                elif token in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"'):
                    shown.append("\n")
            shown.append("\n")
        lines.append("".join(shown))
    text = re.sub(r"\s*\n\s*", "\n", "".join(lines)).strip()
    return text[:TEXT_CHARS], [x for x in links if re.match(r"(?i)(?:https?|hxxps?)://", x)][:PDF_LINKS], "partial" if len(text) > TEXT_CHARS else status


def docx(data: bytes) -> tuple[str, list[str], str]:
    """(text, external links, status) of a DOCX file."""
    if len(data) > DOCX_BYTES:
        return "", [], "oversized"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            def part(name: str) -> bytes:
                return z.read(name) if name in z.namelist() and z.getinfo(name).file_size <= DOCX_PART else b""

            body, rels = part("word/document.xml"), part("word/_rels/document.xml.rels")
        if b"<!DOCTYPE" in body or b"<!DOCTYPE" in rels or not body:
            return "", [], "unreadable"
        paragraphs = ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in ElementTree.fromstring(body).iter(f"{W}p")]
        links = [r.get("Target", "") for r in ElementTree.fromstring(rels)] if rels else []
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError):
        return "", [], "unreadable"
    text = "\n".join(p for p in paragraphs if p.strip())
    return text[:TEXT_CHARS], [x for x in links if x.lower().startswith(("http://", "https://"))], "partial" if len(text) > TEXT_CHARS else "ok"


def _inspect(name: str, kind: str, data: bytes) -> dict:
    if kind == "application/pdf" or name.lower().endswith(".pdf"):
        text, links, status = pdf(data)
    elif name.lower().endswith(".docx") or "wordprocessingml" in kind:
        text, links, status = docx(data)
    else:
        text, links, status = "", [], "not_inspected"
    return {"filename": name, "content_type": kind, "text": text, "links": links, "status": status}


def parse(raw: bytes | None, open_references: bool = True) -> list[dict]:
    """Rows of a message and of those nested in it; open_references as in html.read."""
    rows: list[dict] = []
    todo: list[tuple[EmailMessage, int | None, int]] = [(message_from_bytes(raw or b"", policy=policy.default), None, 0)]
    while todo:
        msg, parent, depth = todo.pop(0)
        node, plain, markup, files, parts = len(rows), [], [], [], 0
        incomplete = False

        def header(name: str, m=msg) -> str | None:
            try:
                return None if m[name] is None else str(m[name])
            except (ValueError, IndexError, AttributeError):
                return None

        def every(name: str, m=msg) -> list[str]:
            try:
                return [str(v) for v in m.get_all(name, [])]
            except (ValueError, IndexError, AttributeError):
                return []

        nested: list[EmailMessage] = []
        stack = [msg]
        while stack:
            part = stack.pop(0)
            parts += 1
            if parts > MAX_PARTS:
                incomplete = True
                break
            kind = part.get_content_type()
            if kind == "message/rfc822" and part is not msg:
                nested += [p for p in part.get_payload() if isinstance(p, EmailMessage)]
                continue
            if part.is_multipart():
                stack = [*part.iter_parts(), *stack] if hasattr(part, "iter_parts") else stack
                continue
            data = part.get_payload(decode=True) or b""
            name = part.get_filename()
            if name or part.get_content_disposition() == "attachment":
                files.append(_inspect(name or "", kind, data))
            elif kind in ("text/plain", "text/html"):
                try:
                    text = data.decode(part.get_content_charset() or "utf-8", "replace")
                except LookupError:
                    text = data.decode("utf-8", "replace")
                (plain if kind == "text/plain" else markup).append(text)
        for child in nested:
            if depth + 1 > MAX_DEPTH or len(rows) + len(todo) >= MAX_NESTED:
                incomplete = True
            else:
                todo.append((child, node, depth + 1))
        read = [H.read(m, open_references) for m in markup]
        rows.append({
            "node": node, "parent": parent, "depth": depth, "sender": header("From"), "reply_to": header("Reply-To"), "return_path": header("Return-Path"),
            "recipients": every("To") + every("Cc"), "subject": header("Subject"), "received": every("Received")[:RECEIVED], "auth_results": every("Authentication-Results"),
            "plain": "\n".join(plain), "html_text": "\n".join(r["visible"] for r in read), "links": [x for r in read for x in r["links"]], "attachments": files, "incomplete": incomplete,
        })
    return rows


#: A clause begins with its method and result; properties stand behind it, values may be quoted.
METHOD = re.compile(r"\s*(spf|dkim|dmarc|arc)(?:/\d+)?\s*=\s*([a-z]+)\b", re.I)
PROPERTY = re.compile(r"\s(smtp\.mailfrom|header\.from|header\.d|header\.i)\s*=\s*(\x00\d+\x00|[^\s;\x00]+)", re.I)


def clauses(value: str | None) -> tuple[list[str], list[str], bool]:
    """Clauses between semicolons without comments, quoted strings replaced by their numbers, those strings, and whether
    all comments and quotes end. A backslash takes the next character as it is, in either."""
    out, quotes, depth, quoted, held = [[]], [], 0, False, []
    chars = iter(value or "")
    for c in chars:
        if c == "\\" and (depth or quoted):
            c = next(chars, "")
            if quoted:
                held.append(c)
        elif quoted:
            if c == '"':
                out[-1].append(f"\x00{len(quotes)}\x00")
                quotes.append("".join(held))
                quoted, held = False, []
            else:
                held.append(c)
        elif c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif depth:
            continue
        elif c == '"':
            quoted = True
        elif c == ";":
            out.append([])
        else:
            out[-1].append(c.replace("\x00", ""))
    return ["".join(x) for x in out], quotes, not depth and not quoted


def authentication(value: str | None) -> dict[str, str]:
    """Results and properties of one Authentication-Results value. A result counts only where its clause begins, so what a
    sender writes into a reason, a comment or a quoted string says nothing; of a method's results the first counts, and of
    a property the first of each. A value whose quotes or comments do not end says nothing at all."""
    parts, quotes, sound = clauses(value)
    out: dict[str, str] = {}
    if not sound:
        return out
    for clause in parts[1:]:
        m = METHOD.match(clause)
        if not m:
            continue
        out.setdefault(m[1].lower(), m[2].lower())
        for p in PROPERTY.finditer(clause, m.end()):
            text = quotes[int(p[2][1:-1])] if p[2][0] == "\x00" else p[2]
            out.setdefault(p[1].lower(), text.lower())
    return out


def authentications(df: DataFrame, *, id_col: str, values_col: str) -> DataFrame:
    """id and results: map of methods and properties to values, of an array of headers; the topmost header wins."""
    kind = df.schema[id_col].dataType.simpleString()

    def read(batches):
        for batch in batches:
            found = []
            for values in batch.column(1):
                own: dict[str, str] = {}
                for v in reversed(values.as_py() or []):
                    own |= authentication(v)
                found.append(list(own.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.map_(pa.string(), pa.string()))], names=[id_col, "results"])

    return df.select(id_col, values_col).mapInArrow(read, f"`{id_col}` {kind}, results map<string,string>")


def header_readings(headers: dict[str, list[str]], most: int = 32, each: int = 8) -> list[dict[str, str]]:
    """Every reading of a message whose headers repeat: one value of each, at most so many of a header and in all; the
    first is that of all first values."""
    out: list[dict[str, str]] = [{}]
    for name in sorted(headers):
        out = [{**r, name: v} for r in out for v in headers[name][:each]][:most] if headers[name] else out
    return out


def messages(df: DataFrame, *, id_col: str, raw_col: str, open_references: bool = True) -> DataFrame:
    """One row for each message and nested message: the id and SCHEMA's columns; open_references as in html.read."""
    kind = df.schema[id_col].dataType.simpleString()
    link = pa.list_(pa.struct([("label", pa.string()), ("destination", pa.string())]))
    file = pa.list_(pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("status", pa.string())]))
    many = pa.list_(pa.string())
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), many, pa.string(), many, many, pa.string(), pa.string(), link, file, pa.bool_()]

    def split(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                ids, rows = [], []
                for own, raw in zip(batch.column(0).slice(a, 64).to_pylist(), batch.column(1).slice(a, 64), strict=True):
                    found = parse(raw.as_py(), open_references)
                    ids += [own] * len(found)
                    rows += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array([r[n] for r in rows], t) for n, t in zip(NAMES, types, strict=True))], names=[id_col, *NAMES])

    return df.select(id_col, F.col(raw_col).cast("binary").alias("_raw")).mapInArrow(split, f"`{id_col}` {kind}, {SCHEMA}")
