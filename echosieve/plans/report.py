"""Reports: JSON and text, of all groups and regions unless a limit is given."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from textwrap import indent

from pyspark.sql import Row
from pyspark.sql import functions as F

from echosieve.plans.session import Session


def parse_spec(spec: str) -> tuple[str, str | None]:
    """(kind, file) of ``console``, ``json`` or ``json:file=PATH``."""
    kind, _, rest = spec.partition(":")
    if kind not in ("console", "json") or (kind == "console" and rest):
        raise ValueError(f"unknown report: {spec}")
    if not rest:
        return kind, None
    key, _, path = rest.partition("=")
    if key != "file" or not path:
        raise ValueError(f"unknown report option: {rest}")
    return kind, path


def duration(seconds: float) -> str:
    if seconds < 1e-3:
        return f"{int(seconds * 1e6)}us"
    return f"{seconds * 1e3:.1f}ms" if seconds < 1 else f"{seconds:.1f}s"


def _rows(session: Session, limit: int | None, source: bool = False) -> tuple[Iterator[Row], Iterator[Row]]:
    """Groups and regions in order, fetched a partition at a time."""
    most = (1 << 31) - 1 if limit is None else limit
    regions = session.intra_regions()
    groups = session.clone_groups(most, source=True) if source else session.clone_groups(most)
    return groups.toLocalIterator(), (regions if limit is None else regions.limit(limit)).toLocalIterator()


def _group(g: Row) -> dict:
    return {
        "groupIndex": g.group_index + 1,
        "blockCount": g.size,
        "avgSimilarity": g.avg_similarity,
        "blocks": [{"name": b.name, "filePath": b.path, "startLine": b.start_line, "startColumn": b.start_col, "endLine": b.end_line, "endColumn": b.end_col} for b in g.blocks],
    }


def _region(r: Row) -> dict:
    return {
        "function": r.name,
        "filePath": r.path,
        "pairs": [{"regionA": {"start": p.a_start, "length": p.a_len}, "regionB": {"start": p.b_start, "length": p.b_len}, "similarity": p.similarity} for p in r.pairs],
    }


def _summary(session: Session) -> dict:
    names = {"files": "totalFiles", "blocks": "totalBlocks", "groups": "totalGroups", "duplicated_functions": "totalFunctions", "duplicated_lines": "totalDuplicatedLines", "intra_functions": "totalIntraFunctions", "intra_pairs": "totalIntraPairs"}
    counts = {names[k]: v for k, v in session.summary().first().asDict().items()}
    timings = getattr(session, "timings", {})
    return counts | ({"timing": {step: duration(seconds) for step, seconds in [*timings.items(), ("total", sum(timings.values()))]}} if timings else {})


def document(session: Session, limit: int | None = None) -> dict:
    """The JSON report: all groups and regions, or the first ``limit``, and the summary of all."""
    groups, regions = _rows(session, limit)
    return {"cloneGroups": [_group(g) for g in groups], "intraClones": [_region(r) for r in regions], "summary": _summary(session)}


def _json_parts(session: Session, limit: int | None) -> Iterator[str]:
    """The JSON report in pieces, so that it is never held as a whole."""
    groups, regions = _rows(session, limit)
    yield "{"
    for name, items in (("cloneGroups", map(_group, groups)), ("intraClones", map(_region, regions))):
        yield f'\n  "{name}": ['
        lead = "\n"
        for item in items:
            yield lead + indent(json.dumps(item, indent=2), "    ")
            lead = ",\n"
        yield "]," if lead == "\n" else "\n  ],"
    yield f'\n  "summary": {indent(json.dumps(_summary(session), indent=2), "  ").lstrip()}\n}}\n'


def _text_parts(session: Session, limit: int | None, source: bool) -> Iterator[str]:
    groups, regions = _rows(session, limit, source)
    for g in groups:
        yield f"Clone group #{g.group_index + 1} ({g.size} blocks, {g.avg_similarity * 100:.0f}% similar)\n"
        for b in g.blocks:
            yield f"  {b.path}:{b.start_line}-{b.end_line} {b.name}\n"
            if source:
                yield "".join(f"    {line}\n" for line in (b.source or "").split("\n"))
    for r in regions:
        yield f"Repeated regions in {r.name} ({r.path}:{r.start_line})\n"
        for p in r.pairs:
            yield f"  tokens {p.a_start}+{p.a_len} and {p.b_start}+{p.b_len}, {p.similarity * 100:.0f}% similar\n"
    s = session.summary().first()
    yield f"{s.files} files, {s.blocks} functions, {s.groups} groups, {s.duplicated_lines} duplicated lines, {s.intra_pairs} repeated regions\n"


def text(session: Session, limit: int | None = None, source: bool = False) -> str:
    return "".join(_text_parts(session, limit, source))


def write_report(session: Session, spec: str = "console", limit: int | None = None, source: bool = False) -> None:
    kind, path = parse_spec(spec)
    parts = _json_parts(session, limit) if kind == "json" else _text_parts(session, limit, source)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(parts)
    else:
        sys.stdout.writelines(parts)


def write_groups(session: Session, path: str) -> None:
    """All groups as JSON lines, written by the executors."""
    session.members().select(F.to_json(F.struct("group_index", "block_id", "name", "path", "start_line", "end_line", "avg_similarity")).alias("value")).write.text(path)
