"""Mapping files: JSON, or the plain part of YAML (nested maps, lists of scalars, comments)."""

from __future__ import annotations

import json
from pathlib import Path


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text == "{}":
        return {}
    if text.startswith("{"):
        raise ValueError(f"maps in one line are not supported: {text}")
    named = {"null": None, "~": None, "": None, "true": True, "false": False}
    if text.lower() in named:
        return named[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def parse(text: str) -> dict:
    """A mapping file's content as a dict."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in map(_uncommented, text.splitlines()) if x.strip()]

    def block(at: int, indent: int):
        if lines[at][1].startswith("- "):
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                out.append(_scalar(lines[at][1][2:]))
                at += 1
            return out, at
        found: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            key, colon, rest = lines[at][1].partition(":")
            if not colon:
                raise ValueError(f"no key in line: {lines[at][1]}")
            at += 1
            if rest.strip() or at >= len(lines) or lines[at][0] < indent or (lines[at][0] == indent and not lines[at][1].startswith("- ")):
                found[_scalar(key)] = _scalar(rest)
            else:
                found[_scalar(key)], at = block(at, lines[at][0])
        return found, at

    found, end = block(0, lines[0][0]) if lines else ({}, 0)
    if end < len(lines):
        raise ValueError(f"odd indent in line: {lines[end][1]}")
    return found


def load(path: str) -> dict:
    return parse(Path(path).read_text())
