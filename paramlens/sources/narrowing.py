"""A manifest's text with the lists of some parameters cut to chosen values; all else, comments too, stays as written.

Parameters stand under ``params`` in ``sfd``, each a list in brackets or with a dash for each value. The text is edited by
lines, as it is what people keep; ``search_space`` counts what the cut leaves.
"""

from __future__ import annotations

import json
import re
from typing import Any

_CHILD = re.compile(r"^(\s*)([A-Za-z_][\w.-]*):(.*)$")
_ITEM = re.compile(r"^(\s*)-\s+(.*?)(\s+#.*)?$")


def scalar(token: str) -> Any:
    """The value that a plain or quoted token stands for."""
    token = token.strip()
    if len(token) >= 2 and token[0] == token[-1] and token[0] in "'\"":
        return token[1:-1].replace("''", "'") if token[0] == "'" else json.loads(token)
    known = {"null": None, "~": None, "": None, "true": True, "false": False}
    if token.lower() in known:
        return known[token.lower()]
    for kind in (int, float):
        try:
            return kind(token)
        except ValueError:
            continue
    return token


def split_list(inner: str) -> list[str]:
    """The tokens between brackets, at commas that no quotes or brackets hold."""
    out, depth, quote, token = [], 0, None, ""
    for c in inner:
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(token.strip())
            token = ""
        else:
            token += c
    return [*out, token.strip()] if token.strip() or out else []


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _blank(line: str) -> bool:
    return not line.strip() or line.lstrip().startswith("#")


def _parameters(lines: list[str]) -> dict[str, tuple[int, int]]:
    """Where each parameter's lines begin and end."""
    def inside(begin: int, end: int) -> tuple[int, int]:
        stop = next((i for i in range(begin + 1, end) if not _blank(lines[i]) and _indent(lines[i]) <= _indent(lines[begin])), end)
        return begin + 1, stop

    at = (0, len(lines))
    for name in ("sfd", "params"):
        begin = next((i for i in range(*at) if (m := _CHILD.match(lines[i])) and m[2] == name and not m[3].split("#")[0].strip()), None)
        if begin is None:
            return {}
        at = inside(begin, at[1])
    own = [i for i in range(*at) if not _blank(lines[i]) and _CHILD.match(lines[i])]
    first = min((_indent(lines[i]) for i in own), default=0)
    begins = [i for i in own if _indent(lines[i]) == first]
    return {_CHILD.match(lines[i])[2]: (i, inside(i, at[1])[1]) for i in begins}


def narrowed(text: str, chosen: dict[str, list]) -> tuple[str, list[str]]:
    """The text with each list cut to the chosen values, and what couldn't be done."""
    lines, problems, gone = text.split("\n"), [], set()
    spans = _parameters(lines)
    for name, values in chosen.items():
        if name not in spans:
            problems.append(f"{name} is not a parameter")
            continue
        begin, end = spans[name]
        head = _CHILD.match(lines[begin])
        items = [(i, m) for i in range(begin + 1, end) if (m := _ITEM.match(lines[i]))]
        flow = re.match(r"^(\s*)\[(.*)\](\s*(?:#.*)?)$", head[3])
        if not flow and not items:
            problems.append(f"{name} is not written as a list")
            continue
        tokens = split_list(flow[2]) if flow else [m[2] for _, m in items]
        told = [(type(scalar(t)) is bool, scalar(t)) for t in tokens]
        missing = [v for v in values if (type(v) is bool, v) not in told]
        keep = [k for k, t in enumerate(told) if t in [(type(v) is bool, v) for v in values]]
        if missing or not keep:
            problems += [f"{name} has no value {json.dumps(v)}" for v in missing] or [f"{name} would have no values"]
        elif flow:
            lines[begin] = f"{head[1]}{name}:{flow[1]}[{', '.join(tokens[k] for k in keep)}]{flow[3]}"
        else:
            gone |= {i for k, (i, _) in enumerate(items) if k not in keep}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), problems
