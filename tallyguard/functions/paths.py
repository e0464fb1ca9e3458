"""Key-path shapes of JSON payloads, as SQL text.

A shape is the set of key paths in a payload: array positions collapse to ``[]``,
``[]`` and ``{}`` count as leaves, and a null leaf is still a leaf.  Value types
never matter, so a field going null does not change the shape.

Two forms exist.  :func:`leaf_paths` walks one payload exactly.  :func:`shape_key`
is the cheap form for grouping large tables: for payloads without containers inside
arrays the inferred type of the payload already fixes the path set, so only the type
text is kept, and :func:`paths_of_key` walks the few distinct keys instead of every
row.
"""

from __future__ import annotations

_NODES = "array<struct<path:string,value:variant,open:boolean>>"


def _is_open(value: str) -> str:
    kind = f"schema_of_variant({value})"
    return f"coalesce(startswith({kind}, 'ARRAY<') or (startswith({kind}, 'OBJECT<') and {kind} != 'OBJECT<>'), false)"


def _node(path: str, value: str) -> str:
    return f"named_struct('path', {path}, 'value', {value}, 'open', {_is_open(value)})"


def _nesting(text: str) -> str:
    """Depth of the brackets in printed JSON, in one pass over them."""
    quotes = f"""replace(replace({text}, r'{chr(92) * 2}'), r'{chr(92)}"')"""
    brackets = f"""regexp_replace(regexp_replace({quotes}, '"[^"]*+"', ''), '[^{{}}\\\\[\\\\]]', '')"""
    return f"""aggregate(split({brackets}, ''), named_struct('now', 0, 'top', 0), (s, c) -> case
        when c in ('{{', '[') then named_struct('now', s.now + 1, 'top', greatest(s.top, s.now + 1))
        when c in ('}}', ']') then named_struct('now', s.now - 1, 'top', s.top) else s end, s -> s.top)"""


def leaf_paths(value: str) -> str:
    """Every leaf path of a VARIANT, one entry per leaf (repeats kept).

    The tree is opened level by level.  The containers in the type text bound the levels;
    a type text with mixed arrays hides some, so there the brackets are counted.
    """
    members = "try_variant_get(n.value, '$', 'map<string,variant>')"
    items = "try_variant_get(n.value, '$', 'array<variant>')"
    member = _node("if(n.path = '', e.key, concat(n.path, '.', e.key))", "e.value")
    item = _node("concat(n.path, '[]')", "i")
    empty = "named_struct('path', concat(n.path, '[]'), 'value', cast(null as variant), 'open', false)"
    grown = f"""flatten(transform(nodes, n -> cast(case
        when not n.open then array(n)
        when {members} is not null then transform(map_entries({members}), e -> {member})
        when size({items}) = 0 then array({empty})
        else transform({items}, i -> {item}) end as {_NODES})))"""
    kind = f"schema_of_variant({value})"
    levels = f"""if(contains({kind}, 'VARIANT'), {_nesting(f'to_json({value})')},
        length({kind}) - length(replace({kind}, '<')))"""
    rounds = f"if({levels} > 0, sequence(1, {levels}), cast(array() as array<int>))"
    start = f"cast(array({_node(chr(39) * 2, value)}) as {_NODES})"
    return f"""if({value} is null, null, aggregate({rounds}, {start},
        (nodes, r) -> if(exists(nodes, n -> n.open), {grown}, nodes), nodes -> transform(nodes, n -> n.path)))"""


def path_set(value: str) -> str:
    """Sorted distinct leaf paths of a VARIANT."""
    return f"array_sort(array_distinct({leaf_paths(value)}))"


def shape_key(value: str, kind: str) -> str:
    """Grouping key: equal keys have equal path sets (the converse may not hold).

    ``kind`` is the type text of ``value``.  The type text serves as the key when it has
    plain key names only and no array that holds containers or mixed items; otherwise
    the exact path list does, marked by a leading "=".
    """
    plain = f"not {kind} rlike '(?=[`VA])(?:`|VARIANT|ARRAY<(?:OBJECT|ARRAY))'"
    reduced = f"regexp_replace({kind}, 'DECIMAL[(][0-9,]+[)]', 'DOUBLE')"
    return f"""case when {value} is null then null when {plain} then {reduced}
        else concat('=', to_json({path_set(value)})) end"""


def paths_of_key(key: str) -> str:
    """Sorted path set behind a :func:`shape_key`; meant for distinct keys only."""
    arrays = f"regexp_replace({key}, 'ARRAY<[A-Z]+>', '[]')"
    scalars = f"regexp_replace({arrays}, '(^|: )(BIGINT|DOUBLE|STRING|BOOLEAN|VOID)', '$10')"
    braces = f"replace(replace({scalars}, 'OBJECT<', '{{'), '>', '}}')"
    skeleton = f"""regexp_replace({braces}, '([A-Za-z0-9_]+): ', '"$1": ')"""
    walked = f"transform(array(try_parse_json({skeleton})), doc -> {path_set('doc')})[0]"
    return f"if(startswith({key}, '='), from_json(substr({key}, 2), 'array<string>'), {walked})"


def fingerprint_text(paths: str) -> str:
    return f"array_join({paths}, '\\n')"


def added_paths(current: str, known: str) -> str:
    return f"array_sort(array_except({current}, {known}))"


def removed_paths(current: str, known: str) -> str:
    return f"array_sort(array_except({known}, {current}))"
