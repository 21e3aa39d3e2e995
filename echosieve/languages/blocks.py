"""Function-level blocks of a token list.

The brace languages are read once, forwards. Every open brace or parenthesis has
a frame of its own; a frame keeps what its statement has shown so far: the last
parameter group with the name before it, what came after that group, and the
last type keyword. When a brace opens, the frame alone says whether the statement
is a function's head and what its name is.

Defined results: of member initializers in parentheses the last one names the
constructor's body, while initializers in braces belong to the head; a
destructor has its class's name; a comment between parameters and body, or a
group after the parameters (``noexcept(...)``), hides the name; a name within two
tokens of a type keyword is a type's; an operator's body has no name, an
initializer's braces are no block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from echosieve.languages import tokens as k
from echosieve.languages.tokens import Token


class Block(NamedTuple):
    name: str
    start: int  # first token
    end: int  # one past the last token


# C++ qualifiers after a parameter list (those of them that are plain names, too), and what a C# constraint clause can hold.
_QUALIFIERS = frozenset("const noexcept override volatile & &&".split())
_QUALIFYING_NAMES = frozenset(("final", "noexcept"))
_CONSTRAINT = frozenset([k.NAME, *", : . < > new class struct cs:null".split()])


def _cpp_tail(tail: list[Token]) -> bool:
    """Qualifiers, and a result type of one name."""
    kinds = [t.kind for t in tail]
    if "->" in kinds:
        at = kinds.index("->")
        if kinds[at + 1 : at + 2] == [k.NAME]:
            tail = tail[:at] + tail[at + 2 :]
    return all(t.kind in _QUALIFIERS or (t.kind == k.NAME and t.text in _QUALIFYING_NAMES) for t in tail)


def _csharp_tail(tail: list[Token]) -> bool:
    """Nothing, or constraint clauses."""
    return not tail or (tail[0].kind == "cs:where" and all(t.kind in _CONSTRAINT or t.kind == "cs:where" for t in tail))


@dataclass(frozen=True)
class BraceLanguage:
    """How a brace language writes the head of a function."""

    joint: str
    types: frozenset[str]
    tail: Callable[[list[Token]], bool]
    accessors: frozenset[str] = frozenset()
    #: Words whose group after a colon belongs to the head, and the word that starts clauses whose groups do.
    chained: frozenset[str] = frozenset()
    clause: str = ""
    brace_initializers: bool = False


CPP = BraceLanguage("::", frozenset("class struct enum union".split()), _cpp_tail, brace_initializers=True)
CSHARP = BraceLanguage(".", frozenset("class struct enum cs:interface".split()), _csharp_tail, frozenset(("cs:get", "cs:set", "cs:init")), frozenset(("cs:base", "this")), "cs:where")


@dataclass
class _Frame:
    """What an open bracket holds of its current statement."""

    closer: str
    #: The bracket's content belongs to the head before it: an initializer's braces, a chained call or a clause's group.
    part: bool = False
    name: str = ""
    tail: list[Token] | None = None  # since the last parameter group; None before the first
    member: tuple[str, list[Token]] | None = None  # name and tail before a colon, while initializers follow
    initialized: bool = False  # an initializer's braces came last
    type_at: int = -3
    namespace: bool = False
    angles: list[int] = field(default_factory=list)
    angle: tuple[int, int] = (-1, -1)  # the last angle bracket closed, and the one it closes
    last: Token | None = None

    def group(self, tokens: list[Token], at: int, language: BraceLanguage) -> bool:
        """A parenthesis opens at ``at``; whether it is part of the head, not a parameter group."""
        tail = self.tail or []
        if tail and ((language.clause and tail[0].kind == language.clause) or (tail[-1].kind in language.chained and [t.kind for t in tail[:-1]] == [":"])):
            return True
        here = at - 1
        if here == self.angle[0]:
            here = self.angle[1] - 1
        self.name = ""
        if here >= 0 and tokens[here].kind == k.NAME:
            typed = self.namespace or here - self.type_at <= 2
            whole = here >= 2 and tokens[here - 1].kind == language.joint and tokens[here - 2].kind == k.NAME
            self.name = "" if typed else f"{tokens[here - 2].text}{language.joint}{tokens[here].text}" if whole else tokens[here].text
        elif here >= 0 and tokens[here].kind == "operator":
            self.name = "operator"
        return False

    def grouped(self, part: bool, language: BraceLanguage) -> None:
        """A parenthesis was closed."""
        self.initialized = False
        if not part:
            self.tail = []
        elif self.tail and self.tail[-1].kind in language.chained:
            self.tail = []

    def take(self, at: int, token: Token, language: BraceLanguage) -> None:
        kind = token.kind
        self.last, self.initialized = token, False
        if kind == "<":
            self.angles.append(at)
        elif kind == ">" and self.angles:
            self.angle = (at, self.angles.pop())
        elif kind in language.types:
            self.type_at = at
        elif kind == "namespace":
            self.namespace = True
        elif kind == ":" and self.tail is not None and self.member is None and language.tail(self.tail):
            self.member = (self.name, [*self.tail])
        if self.tail is not None:
            self.tail.append(token)

    def initializes(self, language: BraceLanguage) -> bool:
        """Whether braces that open now hold a member's first value."""
        if not (language.brace_initializers and self.member and self.tail) or self.initialized:
            return False
        since = self.tail[len(self.tail) - 1 - [t.kind for t in reversed(self.tail)].index(":") :] if any(t.kind == ":" for t in self.tail) else self.tail
        return since[-1].kind == k.NAME and all(t.kind in (":", ",", "::", k.NAME) for t in since)

    def named(self, language: BraceLanguage) -> str:
        """The name of the function whose body opens now; empty if it is none."""
        if self.last and self.last.kind in language.accessors:
            return self.last.text
        if self.tail is None:
            return ""
        if self.initialized and self.member:
            name, tail = self.member
            return name if language.tail(tail) else ""
        return self.name if language.tail(self.tail) else ""


def body_names(tokens: list[Token], language: BraceLanguage) -> dict[int, str]:
    """Opening braces of function bodies, with the functions' names."""
    names: dict[int, str] = {}
    frames = [_Frame("")]
    for at, token in enumerate(tokens):
        here = frames[-1]
        if token.kind == "(":
            frames.append(_Frame(")", here.group(tokens, at, language)))
        elif token.kind == ")":
            if here.closer == ")":
                part = frames.pop().part
                frames[-1].grouped(part, language)
                frames[-1].last = token
        elif token.kind == "{":
            part = here.initializes(language)
            if not part and (name := here.named(language)):
                names[at] = name
            frames.append(_Frame("}", part))
        elif token.kind == "}":
            while len(frames) > 1 and frames[-1].closer != "}":
                frames.pop()
            if len(frames) > 1:
                part, closer = frames.pop().part, frames[-1].closer
                if part:
                    frames[-1].initialized = True
                else:
                    frames[-1] = _Frame(closer, frames[-1].part)
        elif token.kind == ";":
            frames[-1] = _Frame(here.closer, here.part)
        else:
            here.take(at, token, language)
    return names


def brace_blocks(language: BraceLanguage) -> Callable[[list[Token], Callable[[int, int], int], int], list[Block]]:
    """Finder of named brace groups; ``size`` counts the normalized tokens of a range. A group that is too small is looked into, a taken one isn't."""

    def find(tokens: list[Token], size: Callable[[int, int], int], least: int) -> list[Block]:
        close: dict[int, int] = {}
        opened: list[int] = []
        for i, t in enumerate(tokens):
            if t.kind == "{":
                opened.append(i)
            elif t.kind == "}" and opened:
                close[opened.pop()] = i + 1
        out, at = [], 0
        for i, name in body_names(tokens, language).items():
            if i >= at and i in close and size(i, close[i]) >= least:
                out.append(Block(name, i, close[i]))
                at = close[i]
        return out

    return find


def python_blocks(tokens: list[Token], size: Callable[[int, int], int], least: int) -> list[Block]:
    """Bodies of ``def``, by indentation."""
    out, at = [], 0
    for i, t in enumerate(tokens):
        if i < at or t.kind != "py:def" or i + 1 >= len(tokens) or tokens[i + 1].kind != k.NAME:
            continue
        head = tokens[i - 1] if i and tokens[i - 1].kind == "py:async" and tokens[i - 1].line == t.line else t
        depth, colon = 0, None
        for j in range(i + 2, len(tokens)):
            kind = tokens[j].kind
            if kind == ":" and not depth:
                colon = j
                break
            depth = max(0, depth + (kind == "(") - (kind == ")"))
        if colon is None:
            continue
        start = next((j for j in range(colon + 1, len(tokens)) if tokens[j].kind != k.LINE_COMMENT), None)
        if start is None or tokens[start].kind == k.EOF or tokens[start].col <= head.col:
            continue
        end, line = start, tokens[start].line
        while end < len(tokens) and tokens[end].kind != k.EOF and not (tokens[end].line > line and tokens[end].col <= head.col):
            line = tokens[end].line
            end += 1
        if size(start, end) >= least:
            out.append(Block(tokens[i + 1].text, start, end))
            at = end
    return out
