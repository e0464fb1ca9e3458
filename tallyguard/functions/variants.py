"""Reading typed fields out of VARIANT payloads without coercion, as SQL text."""

from __future__ import annotations

from .ecma import double_from


def first_present(payload: str, paths: tuple[str, ...]) -> str:
    """The value at the first of ``paths`` that holds more than JSON null, as VARIANT.

    The last path is returned as it is, so a JSON null can come out of it.
    """
    values = [f"try_variant_get({payload}, '$.{path}', 'variant')" for path in paths]
    earlier = [f"if(is_variant_null({v}), null, {v})" for v in values[:-1]]
    return f"coalesce({', '.join([*earlier, values[-1]])})"


def as_string(value: str, kind: str) -> str:
    """The text of a JSON string; NULL for every other type."""
    return f"if({kind} = 'STRING', try_variant_get({value}, '$', 'string'), null)"


def as_double(value: str, kind: str) -> str:
    """The value of a JSON number; NULL for every other type."""
    return double_from(value, kind)
