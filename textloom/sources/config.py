"""Configuration files and their locks: JSON, and YAML of mappings, lists and scalars."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path


class Drift(Exception):
    """A locked file is missing, was never locked, or has changed."""


def scalar(text: str):
    text = text.strip()
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text[0] in "\"'[{":
        return json.loads(text) if text[0] != "'" else text[1:-1].replace("''", "'")
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def loads(text: str):
    """A mapping or list of block-style YAML with scalar leaves; flow lists and quoted strings as in JSON."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, indent: int):
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1][:1] == "-":
                rest = lines[i][1][1:].strip()
                if not rest:
                    value, i = block(i + 1, lines[i + 1][0])
                elif key_end(rest) is not None:
                    lines[i] = (indent + 2, rest)
                    value, i = block(i, indent + 2)
                else:
                    value, i = scalar(rest), i + 1
                out.append(value)
            return out, i
        found = {}
        while i < len(lines) and lines[i][0] == indent and (k := key_end(lines[i][1])) is not None:
            key, rest = scalar(lines[i][1][:k]), lines[i][1][k + 1 :].strip()
            nested = i + 1 < len(lines) and (lines[i + 1][0] > indent or lines[i + 1][0] == indent and lines[i + 1][1][:1] == "-")
            if rest or not nested:
                found[key], i = scalar(rest), i + 1
            else:
                found[key], i = block(i + 1, lines[i + 1][0])
        return found, i

    def key_end(line: str) -> int | None:
        if line[:1] in "\"'":
            end = line.find(line[0], 1)
            return end + 1 if end > 0 and line[end + 1 : end + 2] == ":" else None
        k = line.find(": ")
        return k if k >= 0 else len(line) - 1 if line.endswith(":") else None

    return block(0, lines[0][0])[0] if lines else {}


def dumps(value, indent: int = 0) -> str:
    pad = " " * indent
    plain = lambda v: json.dumps(v, ensure_ascii=False)
    if isinstance(value, dict):
        return "\n".join(f"{pad}{plain(str(k))}:" + (f"\n{dumps(v, indent + 2)}" if isinstance(v, (dict, list)) and v else f" {plain(v)}") for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{pad}-\n{dumps(v, indent + 2)}" if isinstance(v, (dict, list)) and v else f"{pad}- {plain(v)}" for v in value)
    return pad + plain(value)


def digest(path: str | Path) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def lock(path: str | Path, locks: dict[str, str]) -> dict[str, str]:
    return locks | {str(path): digest(path)}


def check_lock(path: str | Path, locks: dict[str, str]) -> None:
    """Raises Drift unless the file is there and as it was locked."""
    if str(path) not in locks:
        raise Drift(f"{path} was never locked")
    if not Path(path).exists():
        raise Drift(f"{path} is missing")
    if digest(path) != locks[str(path)]:
        raise Drift(f"{path} has changed since it was locked")
