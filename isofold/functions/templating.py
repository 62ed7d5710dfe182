"""Variables in statements: {name} is a field's values joined by commas, {name[i]} one of them; innermost braces go first."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

_INNER = re.compile(r"\{([^{}]*)\}")
_ELEMENT = re.compile(r"(.*)\[(\s*\d+\s*)\]\s*", re.S)


class TemplateError(ValueError):
    pass


def _text(v: object) -> str:
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def substitute(text: str, fields: Mapping[str, Sequence | object]) -> str:
    """text with its variables replaced; unknown names, indices out of range and unbalanced braces raise TemplateError."""

    def value(m: re.Match) -> str:
        body = m[1]
        element = _ELEMENT.fullmatch(body)
        name = (element[1] if element else body).strip()
        if name not in fields:
            raise TemplateError(f"no field named {name!r}")
        values = fields[name]
        values = list(values) if isinstance(values, (list, tuple)) else [values]
        if element is None:
            return ",".join(map(_text, values))
        i = int(element[2])
        if i >= len(values):
            raise TemplateError(f"{name} has {len(values)} values, none at {i}")
        return _text(values[i])

    while _INNER.search(text):
        text = _INNER.sub(value, text)
    if "{" in text or "}" in text:
        raise TemplateError("unbalanced braces")
    return text


def listed(text: str) -> list[str]:
    """The items of "a,b,c"; blanks around them and a comma at the end are ignored."""
    items = [x.strip() for x in text.split(",")]
    return items[:-1] if items and not items[-1] else items


def numbers(text: str) -> list[float] | None:
    """The items as numbers, or None if any isn't one."""
    try:
        return [float(x) for x in listed(text)]
    except ValueError:
        return None
