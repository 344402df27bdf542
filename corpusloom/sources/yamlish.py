"""A reader of the YAML that technique and front-matter files use: an indentation stack, no library.

Read are nested maps and lists, literal and folded block scalars with their chomping and
indentation marks, plain scalars over several lines, quoted scalars, and flow lists and
maps. Plain scalars become null, booleans, numbers or text, as in YAML 1.1. Anchors, aliases,
tags, tabs as indentation and a second document are errors.
"""

from __future__ import annotations

import re

KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\-?:,\[\]{}&*!|>'"%@`][^#]*?|[-?:](?=\S)[^#]*?|[^\s,\[\]{}&*!|>'"%@`][^:]*?)\s*:(?=\s|$)""")
BLOCK = re.compile(r"([|>])(?:([+-])?([1-9])?|([1-9])([+-]))\s*(?:#.*)?$")
INT = re.compile(r"[-+]?(0|[1-9][0-9_]*)$")
HEX = re.compile(r"[-+]?0x[0-9a-fA-F_]+$")
OCTAL = re.compile(r"[-+]?0[0-7_]+$")
FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?)$")
BOOLS = {**dict.fromkeys(["yes", "true", "on"], True), **dict.fromkeys(["no", "false", "off"], False)}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "e": "\x1b", "_": "\xa0", "N": "\x85", "L": "\u2028", "P": "\u2029"}


class YamlError(ValueError):
    """A file that this reader cannot read."""


def scalar(text: str) -> object:
    """A plain scalar's value."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in BOOLS and text in (text.lower(), text.upper(), text.capitalize()):
        return BOOLS[text.lower()]
    if INT.match(text):
        return int(text.replace("_", ""))
    if HEX.match(text):
        return int(text.replace("_", ""), 16)
    if OCTAL.match(text):
        return int(text.replace("_", ""), 8)
    return float(text.replace("_", "")) if FLOAT.match(text) else text


def unquoted(text: str) -> str:
    """What a quoted scalar says."""
    if text[0] == "'":
        return text[1:-1].replace("''", "'")

    def one(m: re.Match) -> str:
        c = m[0]
        if len(c) > 2:
            return chr(int(c[2:], 16))
        return ESCAPES.get(c[1], c[1])

    return re.sub(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, text[1:-1], flags=re.S)


def folded(lines: list[str]) -> str:
    """Lines of a scalar in one: a break is a space, and of several breaks all but the first stay."""
    out, gap = "", 0
    for k, line in enumerate(lines):
        if not line:
            gap += 1
            continue
        out += ("\n" * gap if gap else " " if k else "") + line
        gap = 0
    return out


def without_comment(text: str) -> str:
    return re.sub(r"(?:^|\s)#.*$", "", text, flags=re.S).strip()


class Reader:
    def __init__(self, text: str) -> None:
        self.lines = [line.rstrip("\r") for line in text.removeprefix("\ufeff").split("\n")]
        self.at = 0
        while self.at < len(self.lines) and (self.lines[self.at].startswith("%") or not without_comment(self.lines[self.at])):
            self.at += 1
        if self.at < len(self.lines) and re.match(r"---(\s|$)", self.lines[self.at]):
            self.lines[self.at] = "   " + self.lines[self.at][3:]
        for n in range(self.at, len(self.lines)):
            if re.match(r"\.\.\.\s*$", self.lines[n]):
                del self.lines[n:]
                break
            if re.match(r"---(\s|$)", self.lines[n]):
                raise YamlError(f"line {n + 1}: a second document")

    def indent(self) -> int:
        """Of the next line that says something; -1 at the end."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.lstrip(" ")
            if body.startswith("\t") and body.strip():
                raise self.fault("a tab as indentation")
            if body and not body.startswith("#") and body.strip():
                return len(line) - len(body)
            self.at += 1
        return -1

    def fault(self, what: str) -> YamlError:
        return YamlError(f"line {self.at + 1}: {what}")

    def document(self) -> object:
        value = self.block(0)
        if self.indent() >= 0:
            raise self.fault("what stands here belongs to nothing")
        return value

    def block(self, least: int) -> object:
        own = self.indent()
        if own < least:
            return None
        body = self.lines[self.at][own:]
        if body == "-" or body.startswith("- "):
            return self.items(own)
        if body[0] not in "[{" and KEY.match(body):
            return self.entries(own)
        self.at += 1
        return self.value(body, own - 1)

    def items(self, own: int) -> list:
        out = []
        while self.indent() == own and re.match(r"-(\s|$)", self.lines[self.at][own:]):
            rest = self.lines[self.at][own + 1 :]
            if not without_comment(rest):
                self.at += 1
                out.append(self.block(own + 1))
            elif BLOCK.match(rest.strip()):
                self.at += 1
                out.append(self.text(rest.strip(), own))
            else:  # what follows the dash is a line of its own, further in
                self.lines[self.at] = " " * (own + 1) + rest
                out.append(self.block(own + 1))
        if self.indent() > own:
            raise self.fault("an item was expected")
        return out

    def entries(self, own: int) -> dict:
        out: dict = {}
        while self.indent() == own:
            body = self.lines[self.at][own:]
            found = KEY.match(body)
            if not found:
                if re.match(r"-(\s|$)", body):
                    break
                raise self.fault("a key was expected")
            key = unquoted(found[1]) if found[1][0] in "'\"" else scalar(found[1])
            self.at += 1
            rest = body[found.end() :].strip()
            if without_comment(rest):
                out[key] = self.value(rest, own)
            elif self.indent() > own:
                out[key] = self.block(own + 1)
            elif self.indent() == own and re.match(r"-(\s|$)", self.lines[self.at][own:]):
                out[key] = self.items(own)
            else:
                out[key] = None
        if self.indent() > own:
            raise self.fault("this is too far in")
        return out

    def value(self, rest: str, own: int) -> object:
        """A value that begins on a line which has been passed; ``own`` is the indentation of what holds it."""
        if BLOCK.match(rest):
            return self.text(rest, own)
        if rest[0] in "'\"":
            return self.quoted(rest, own)
        if rest[0] in "[{":
            while (end := self.flow_end(rest)) is None:
                if self.at >= len(self.lines):
                    raise self.fault("a flow value is not closed")
                rest += " " + self.lines[self.at].strip()
                self.at += 1
            if without_comment(rest[end:]):
                raise self.fault("something follows a flow value")
            return Flow(rest[:end]).whole()
        if rest[0] in "&*!%@`|>":
            raise self.fault("anchors, tags and other marks are not read")
        lines = [without_comment(rest)]
        if lines[0] == rest.rstrip():  # a comment ends a plain scalar
            while self.at < len(self.lines):
                line = self.lines[self.at]
                if line.strip() and (len(line) - len(line.lstrip(" ")) <= own or line.lstrip().startswith("#")):
                    break
                if line.strip() and KEY.match(line.strip()):
                    raise self.fault("a map within a plain scalar")
                lines.append(line.strip())
                self.at += 1
        while not lines[-1]:
            lines.pop()
        return scalar(lines[0]) if len(lines) == 1 else folded(lines)

    def flow_end(self, text: str) -> int | None:
        """Where the brackets close; quotes and what they hold are passed over."""
        depth = 0
        for m in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[\[\]{}]", text):
            depth += (m[0] in "[{") - (m[0] in "]}")
            if not depth:
                return m.end()
        return None

    def quoted(self, rest: str, own: int) -> str:
        form = re.compile(r"\"(?:[^\"\\]|\\.)*\"" if rest[0] == '"' else r"'(?:[^']|'')*'", re.S)
        lines = [rest]
        while not (found := form.match("\n".join(lines))):
            if self.at >= len(self.lines):
                raise self.fault("a quote is not closed")
            lines.append(self.lines[self.at].strip())
            self.at += 1
        if without_comment("\n".join(lines)[found.end() :]):
            raise self.fault("something follows a quoted value")
        return unquoted(folded([x.strip() if k else x.rstrip() for k, x in enumerate(found[0].split("\n"))]) if len(lines) > 1 else found[0])

    def text(self, header: str, own: int) -> str:
        """A block scalar, literal or folded."""
        m = BLOCK.match(header)
        keep, number = m[2] or m[5] or "", m[3] or m[4]
        inside = own + int(number) if number else None
        lines: list[str] = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            size = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if inside is None:
                    if size <= own:
                        break
                    inside = size
                if size < inside:
                    break
            lines.append(line[inside:] if inside is not None else "")
            self.at += 1
        tail = 0
        while lines and not lines[-1]:
            lines.pop()
            tail += 1
        if not lines:
            return "\n" * tail if keep == "+" else ""
        end = {"+": "\n" * max(1, tail + (self.at < len(self.lines))), "-": "", "": "\n"}[keep]
        if m[1] == "|":
            return "\n".join(lines) + end
        out, gap = lines[0], 0
        for before, line in zip(lines, lines[1:], strict=False):
            if not line:
                gap += 1
                continue
            inner = line[0] in " \t" or (not gap and before[:1] in (" ", "\t"))
            out += ("\n" * (gap + inner) if gap or inner else " ") + line
            gap = 0
        return out + end


class Flow:
    """Lists and maps in brackets."""

    def __init__(self, text: str) -> None:
        self.tokens = re.findall(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s,\]}])|[^\s\[\]{},:'\"](?:[^\[\]{},:]|:(?=\S))*", text)
        self.at = 0

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise YamlError("a flow value is cut short")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> object:
        return self.one(self.next())

    def one(self, t: str) -> object:
        if t == "[":
            return list(self.until("]"))
        if t == "{":
            return dict(self.pair(x) for x in self.parts("}"))
        if t in "]},:":
            raise YamlError(f"{t} where a value was expected")
        return unquoted(t) if t[0] in "'\"" else scalar(t.strip())

    def parts(self, end: str):
        while (t := self.next()) != end:
            if t != ",":
                yield t

    def until(self, end: str):
        for t in self.parts(end):
            yield self.one(t)

    def pair(self, t: str) -> tuple:
        key = self.one(t)
        if self.at < len(self.tokens) and self.tokens[self.at] == ":":
            self.at += 1
            if self.tokens[self.at] in ",}":
                return key, None
            return key, self.one(self.next())
        return key, None


def load(text: str) -> object:
    """The document of a text; ``YamlError`` if it cannot be read."""
    try:
        return Reader(text).document()
    except (IndexError, RecursionError) as e:
        raise YamlError(str(e)) from e
