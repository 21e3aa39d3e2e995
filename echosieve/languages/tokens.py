"""Token kinds.

A kind is a short string: the special kinds below, an operator's own text, or a
keyword. Keywords that the C++ table has are shared by the languages that use
them; others carry their language's mark, so that C# ``as`` and Python ``as``
differ. The number of a kind is its place in ``KINDS``.
"""

from __future__ import annotations

from typing import NamedTuple

EOF, INVALID, NUMBER, STRING, CHAR, NAME, LINE_COMMENT, BLOCK_COMMENT, DIRECTIVE = SPECIAL = ("eof", "invalid", "number", "string", "char-literal", "name", "line-comment", "block-comment", "directive")

# The keywords and operators of the three languages.
CPP_KEYWORDS = (
    "alignas alignof auto bool break case catch char char8_t char16_t char32_t class co_await co_return co_yield concept const consteval constexpr constinit "
    "continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace "
    "new noexcept nullptr operator override private protected public register reinterpret_cast requires return short signed sizeof static static_assert "
    "static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while"
).split()
CSHARP_KEYWORDS = (
    "abstract and as async await base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit "
    "extern false finally fixed float for foreach get goto if in init int interface internal is lock long nameof namespace new not null object operator or out "
    "override params partial private protected public readonly record ref return sbyte sealed set short sizeof stackalloc static string struct switch this "
    "throw true try typedef typeof uint ulong unchecked unsafe ushort using value var virtual void volatile when where while with yield"
).split()
PYTHON_KEYWORDS = (
    "False None True and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match "
    "nonlocal not or pass raise return try type while with yield"
).split()
#: Python keywords that mean the same as a shared one.
PYTHON_SHARED = {w: w.lower() for w in "False True break class continue else for if return try while".split()}
CPP_OPERATORS = "->* ... <<= <=> >>= != ## %= && &= *= ++ += -- -= -> .* /= :: << <= == >= >> ^= |= ||".split()
CSHARP_OPERATORS = "... <<= ??= >>= != %= && &= *= ++ += -- -= /= << <= == => >= >> ?. ?? ^= |= ||".split()
PYTHON_OPERATORS = "**= ... //= <<= >>= != %= &= ** *= += -= -> // /= := << <= == >= >> @= ^= |=".split()
#: One-character operators of C++ and C#, and of Python.
SINGLE, PYTHON_SINGLE = "()[]{};:,.~!+-*/%&|^<>=?#", "()[]{};:,.~+-*/%&|^<>=@"


def csharp_kind(word: str) -> str:
    return word if word in CPP_KEYWORDS else f"cs:{word}"


def python_kind(word: str) -> str:
    return PYTHON_SHARED.get(word, f"py:{word}")


def _kinds() -> list[str]:
    words = [*CPP_KEYWORDS, *map(csharp_kind, CSHARP_KEYWORDS), *map(python_kind, PYTHON_KEYWORDS)]
    marks = [*SINGLE, *PYTHON_SINGLE, *CPP_OPERATORS, *CSHARP_OPERATORS, *PYTHON_OPERATORS]
    return list(dict.fromkeys([*SPECIAL, *words, *marks]))


KINDS = _kinds()
NUMBER_OF = {kind: i for i, kind in enumerate(KINDS)}
#: Structural ids of names and literals; all other tokens have their kind's number.
GENERIC = {NAME: 1000, NUMBER: 1001, STRING: 1002, CHAR: 1003}
_WORDS = frozenset([*CPP_KEYWORDS, *map(csharp_kind, CSHARP_KEYWORDS), *map(python_kind, PYTHON_KEYWORDS)])
_MARKS = frozenset([*SINGLE, *PYTHON_SINGLE, *CPP_OPERATORS, *CSHARP_OPERATORS, *PYTHON_OPERATORS])


def is_operator(kind: str) -> bool:
    return kind in _MARKS


def is_csharp(kind: str) -> bool:
    return kind.startswith("cs:") or kind in ("?.", "??", "??=", "=>")


def is_python(kind: str) -> bool:
    return kind.startswith("py:") or kind in ("@", "@=", "**", "**=", "//", "//=", ":=")


def is_comment(kind: str) -> bool:
    return kind in (LINE_COMMENT, BLOCK_COMMENT)


def is_literal(kind: str) -> bool:
    return kind in (NUMBER, STRING, CHAR)


def is_keyword(kind: str) -> bool:
    """Keywords of any language."""
    return kind in _WORDS


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    col: int


class ScanError(Exception):
    """A source that can't be tokenized as a whole."""

    def __init__(self, message: str, line: int, col: int):
        super().__init__(message)
        self.message, self.line, self.col = message, line, col
