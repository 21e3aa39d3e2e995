"""The languages, by name and by file extension. New ones are added with ``register``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePath

from echosieve.languages import blocks, scanners
from echosieve.languages import tokens as k
from echosieve.languages.tokens import Token


def whole_text(tokens: list[Token], size: Callable[[int, int], int], least: int) -> list[blocks.Block]:
    """The text as one block, for languages without functions."""
    end = len(tokens) - 1
    return [blocks.Block("text", 0, end)] if end and size(0, end) >= least else []


@dataclass(frozen=True)
class LanguageSpec:
    """What the engine has to know of a language; the callables run on the workers."""

    name: str
    extensions: tuple[str, ...]
    tokenize: Callable[[bytes], list[Token]]
    find_blocks: Callable[[list[Token], Callable[[int, int], int], int], list[blocks.Block]]
    strip: frozenset[str] = frozenset((k.LINE_COMMENT, k.BLOCK_COMMENT, k.DIRECTIVE, k.EOF))


_languages: dict[str, LanguageSpec] = {}


def register(spec: LanguageSpec) -> None:
    _languages[spec.name] = spec


register(LanguageSpec("C++", (".cpp", ".hpp", ".cc", ".cxx", ".h", ".c", ".hxx"), scanners.scan_cpp, blocks.brace_blocks(blocks.CPP)))
register(LanguageSpec("C#", (".cs",), scanners.scan_csharp, blocks.brace_blocks(blocks.CSHARP)))
register(LanguageSpec("Python", (".py", ".pyw"), scanners.scan_python, blocks.python_blocks, frozenset((k.LINE_COMMENT, k.BLOCK_COMMENT, k.EOF))))
register(LanguageSpec("prose", (".txt", ".md"), scanners.scan_prose, whole_text))


def languages() -> list[LanguageSpec]:
    return list(_languages.values())


def by_name(name: str) -> LanguageSpec | None:
    return _languages.get(name)


def by_extension(extension: str) -> LanguageSpec | None:
    """The first language with the extension, whatever its case."""
    return next((x for x in _languages.values() if extension.lower() in x.extensions), None)


def by_path(path: str) -> LanguageSpec | None:
    return by_extension(PurePath(path).suffix)


def code_extensions() -> list[str]:
    """Extensions of the programming languages."""
    return [e for x in _languages.values() if x.name != "prose" for e in x.extensions]
