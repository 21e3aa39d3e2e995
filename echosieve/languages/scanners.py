"""Tokenizers, as tables of patterns over bytes.

A source's bytes are read as Latin-1, so that one character is one byte and
columns count bytes; texts are turned back to UTF-8. A scanner is one compiled
pattern whose named groups are the kinds; a group ``bad_...`` marks a literal or
comment that doesn't end, for which the whole source fails.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from echosieve.languages import tokens as k
from echosieve.languages.tokens import ScanError, Token

_SPACE = re.compile(r"[ \t\r\n]+")


def _any(operators: list[str], single: str) -> str:
    longest = sorted(operators, key=len, reverse=True)
    return "|".join([*map(re.escape, longest), *map(re.escape, single)])


def _decimal(mark: str, tail: str, more: str = "") -> str:
    """Digits with a separator, a fraction only before a digit or exponent (or, after digits, a suffix in ``more``), an exponent."""
    digits = f"[0-9{mark}]*"
    dot = rf"\.(?=[0-9eE{more}]){digits}"
    return rf"(?:[0-9]{digits}(?:{dot})?|\.(?=[0-9eE]){digits})(?:[eE][+-]?{digits})?{tail}"


def _quoted(quote: str) -> str:
    return rf"{quote}(?:\\[\s\S]|[^\\\n{quote}])*{quote}"


_CPP_PREFIX = "(?:u8|u|U|L)?"
_CPP = re.compile(
    "|".join(
        [
            r"(?P<line_comment>//[^\n]*)",
            r"(?P<block_comment>/\*[\s\S]*?\*/)|(?P<bad_block>/\*)",
            rf"(?P<raw>{_CPP_PREFIX}R\"(?P<delim>[^(]{{0,16}})\([\s\S]*?\)(?P=delim)\")|(?P<bad_raw>{_CPP_PREFIX}R\")",
            rf"(?P<string>{_CPP_PREFIX}{_quoted(chr(34))})|(?P<bad_string>{_CPP_PREFIX}\")",
            rf"(?P<char>{_CPP_PREFIX}{_quoted(chr(39))})|(?P<bad_char>{_CPP_PREFIX}')",
            r"(?P<name>[A-Za-z_][A-Za-z0-9_]*)",
            rf"(?P<number>0[xX][0-9a-fA-F']*[uUlLfFzZ]*|0[bB][01']*[uUlLfFzZ]*|0(?=[0-7])[0-7']*[uUlLfFzZ]*|{_decimal(chr(39), '[uUlLfFzZ]*', 'fFlL')})",
            rf"(?P<operator>{_any(k.CPP_OPERATORS, k.SINGLE)})",
        ]
    )
)
_CSHARP = re.compile(
    "|".join(
        [
            r"(?P<line_comment>//[^\n]*)",
            r"(?P<block_comment>/\*[\s\S]*?\*/)|(?P<bad_block>/\*)",
            r"(?P<verbatim>(?:@|\$@|@\$)\"(?:[^\"]|\"\")*\"(?!\"))|(?P<bad_verbatim>(?:@|\$@|@\$)\")",
            r"(?P<interpolated>\$\")",
            r"(?P<fence>\"\"\"\"*)",
            rf"(?P<string>{_quoted(chr(34))})|(?P<bad_string>\")",
            rf"(?P<char>{_quoted(chr(39))})|(?P<bad_char>')",
            r"(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<plain_name>@[A-Za-z_][A-Za-z0-9_]*)",
            rf"(?P<number>0[xX][0-9a-fA-F_]*[uUlLfFdDmM]*|0[bB][01_]*[uUlLfFdDmM]*|{_decimal('_', '[uUlLfFdDmM]*', 'fFdDmM')})",
            rf"(?P<operator>{_any(k.CSHARP_OPERATORS, k.SINGLE)})",
        ]
    )
)
_PY_PREFIX = "(?:[rR][bBfF]|[bBfF][rR]|[rRbBfFuU])?"
_PYTHON = re.compile(
    "|".join(
        [
            r"(?P<line_comment>#[^\n]*)",
            *(rf"(?P<triple{i}>{_PY_PREFIX}{q * 3}(?:\\[\s\S]|(?!{q * 3})[^\\])*{q * 3})|(?P<bad_triple{i}>{_PY_PREFIX}{q * 3})" for i, q in enumerate("\"'")),
            *(rf"(?P<string{i}>{_PY_PREFIX}{_quoted(q)})|(?P<bad_string{i}>{_PY_PREFIX}{q})" for i, q in enumerate("\"'")),
            r"(?P<name>[A-Za-z_][A-Za-z0-9_]*)",
            rf"(?P<number>0[xX][0-9a-fA-F_]*|0[oO][0-7_]*|0[bB][01_]*|{_decimal('_', '[jJ]?')})",
            rf"(?P<operator>{_any(k.PYTHON_OPERATORS, k.PYTHON_SINGLE)})",
        ]
    )
)
_LINE = re.compile(r"#(?:\\\n|[^\n])*"), re.compile(r"#[^\n]*")
_ERRORS = {
    "bad_block": "Unterminated block comment", "bad_raw": "Unterminated raw string literal", "bad_string": "Unterminated string literal", "bad_char": "Unterminated character literal",
    "bad_verbatim": "Unterminated verbatim string literal", "bad_triple": "Unterminated triple-quoted string literal",
}


def _interpolated_end(s: str, at: int) -> int:
    """End of a C# interpolated string whose text starts at ``at``; -1 if it doesn't end. Braces may hold quotes and line ends."""
    depth = 0
    for m in re.compile(r"\\[\s\S]?|\{\{|\}\}|[{}\"\n]").finditer(s, at):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth = max(0, depth - 1)
        elif c == '"' and not depth:
            return m.end()
        elif c == "\n" and not depth:
            return -1
    return -1


class Scanner:
    """Tokenizer of one language."""

    def __init__(self, pattern: re.Pattern[str], kinds: dict[str, str], directive: re.Pattern[str] | None):
        self.pattern, self.kinds, self.directive = pattern, kinds, directive

    def __call__(self, source: bytes) -> list[Token]:
        s = source.decode("latin-1")
        starts = [0, *(m.end() for m in re.finditer("\n", s))]
        out: list[Token] = []
        at = 0

        def place(pos: int) -> tuple[int, int]:
            line = bisect_right(starts, pos)
            return line, pos - starts[line - 1] + 1

        def put(kind: str, end: int) -> None:
            out.append(Token(kind, s[at:end].encode("latin-1").decode("utf-8", "replace"), *place(at)))

        while True:
            if m := _SPACE.match(s, at):
                at = m.end()
            if at >= len(s):
                out.append(Token(k.EOF, "", *place(at)))
                return out
            if self.directive and s[at] == "#" and not s[s.rfind("\n", 0, at) + 1 : at].strip(" \t"):
                end = self.directive.match(s, at).end()
                put(k.DIRECTIVE, end)
                at = end
                continue
            m = self.pattern.match(s, at)
            group = m.lastgroup if m else None
            if m is None:
                put(k.INVALID, at + 1)
                at += 1
                continue
            end = m.end()
            if group == "delim":
                group = "raw"
            group = group.rstrip("01")
            if group.startswith("bad_"):
                message = _ERRORS[group]
                if group == "bad_raw" and "(" not in s[end : end + 17] and len(s) > end + 16:
                    message = "Raw string delimiter too long"
                raise ScanError(message, *place(at))
            if group == "interpolated":
                end = _interpolated_end(s, end)
                if end < 0:
                    raise ScanError("Unterminated interpolated string literal", *place(at))
            elif group == "fence":
                close = s.find(m[0], end)
                if close < 0:
                    raise ScanError("Unterminated raw string literal", *place(at))
                end = close + len(m[0])
            if group == "operator":
                kind = m[0]
            elif group == "name":
                kind = self.kinds.get(m[0], k.NAME)
            else:
                kind = {"line_comment": k.LINE_COMMENT, "block_comment": k.BLOCK_COMMENT, "number": k.NUMBER, "char": k.CHAR, "plain_name": k.NAME}.get(group, k.STRING)
            put(kind, end)
            at = end


scan_cpp = Scanner(_CPP, {w: w for w in k.CPP_KEYWORDS}, _LINE[0])
scan_csharp = Scanner(_CSHARP, {w: k.csharp_kind(w) for w in k.CSHARP_KEYWORDS}, _LINE[1])
scan_python = Scanner(_PYTHON, {w: k.python_kind(w) for w in k.PYTHON_KEYWORDS}, None)

_PROSE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t-\rA-Za-z0-9_]")


def scan_prose(source: bytes) -> list[Token]:
    """Words, numbers and single other characters of a text; every token is a name, so only its text counts."""
    out = []
    for line, text in enumerate(source.decode("utf-8", "replace").split("\n"), 1):
        out += [Token(k.NAME, m[0], line, m.start() + 1) for m in _PROSE.finditer(text)]
    return [*out, Token(k.EOF, "", 1, 1)]
