"""JSON text as an ECMAScript runtime prints it, in JVM expressions only.

Content hashes are taken over JSON text, so two spellings of one number
(``1e2`` and ``100``) must print the same.  ``to_json`` of a VARIANT already
sorts keys and drops trailing zeros; the rest of the differences are rare and are
fixed by a rewrite that runs only on rows a cheap test picks out.

The functions build SQL text around SQL expressions, which keeps plan building cheap.
"""

from __future__ import annotations


def _literal(text: str) -> str:
    return "r'" + text + "'" if "\\" in text else "'" + text + "'"


def number_text(number: str) -> str:
    """Shortest decimal text of a DOUBLE under the ECMAScript rules."""
    split = """transform(array(cast(abs(n) as string)), t -> struct(
        concat(substring_index(substring_index(t, 'E', 1), '.', 1),
               substring_index(substring_index(t, 'E', 1), '.', -1)) as raw,
        length(substring_index(t, '.', 1))
          + if(contains(t, 'E'), cast(substring_index(t, 'E', -1) as int), 0) as point))"""
    strip = f"""transform({split}, s -> struct(
        rtrim('0', ltrim('0', s.raw)) as digits,
        s.point - length(s.raw) + length(ltrim('0', s.raw)) as point))"""
    layout = f"""transform({strip}, d -> case
        when length(d.digits) = 0 then '0'
        when length(d.digits) <= d.point and d.point <= 21 then rpad(d.digits, d.point, '0')
        when d.point between 1 and 21
          then concat(left(d.digits, d.point), '.', substr(d.digits, d.point + 1))
        when d.point between -5 and 0 then concat('0.', repeat('0', -d.point), d.digits)
        else concat(left(d.digits, 1),
                    if(length(d.digits) > 1, concat('.', substr(d.digits, 2)), ''),
                    if(d.point < 1, 'e-', 'e+'), cast(abs(d.point - 1) as string))
        end)[0]"""
    return f"""transform(array({number}), n -> case
        when abs(n) = double('Infinity') then 'null'
        when n < 0 then concat('-', {layout})
        else {layout} end)[0]"""


def is_suspect(text: str) -> str:
    """Whether printed JSON may differ: exponents, doubles printed as "100.0", numbers
    beyond double precision, very small decimals, control-character escapes.

    One pass of a pattern, which most characters leave at once; a search for each text compares at every byte.
    """
    return f"{text} rlike {_literal(_SUSPECT)}"


_SUSPECT = r"(?=[0-9.\\])(?:[0-9.]{16}|[.]0(?:[,}\]]|00000|\z)|[0-9]E|\\u00)"


# JSON escapes whose hex digits hold a letter.
_UPPER_ESCAPES = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]

# With escaped backslashes and quotes masked, a JSON string has no inner quote, so one
# pattern without a repeated group splits the text (no recursion in the matcher).
_TOKEN = r'("[^"]*+"|-?[0-9][0-9.eE+-]*+|[{}\[\]:,]|[a-z]++)'


def reprint(text: str) -> str:
    """Printed JSON with every number and control escape in ECMAScript form."""
    masked = f"replace(replace({text}, {_literal(chr(92) * 2)}, char(1)), {_literal(chr(92) + chr(34))}, char(2))"
    lowered = "tok"
    for code in _UPPER_ESCAPES:
        lowered = f"replace({lowered}, {_literal(chr(92) + 'u' + code)}, {_literal(chr(92) + 'u' + code.lower())})"
    fixed = f"""transform(regexp_extract_all({masked}, {_literal(_TOKEN)}, 1), tok -> case
        when tok rlike '^-?[0-9]' then {number_text("try_cast(tok as double)")}
        when contains(tok, {_literal(chr(92) + 'u00')}) then {lowered}
        else tok end)"""
    joined = f"array_join({fixed}, '')"
    return f"replace(replace({joined}, char(1), {_literal(chr(92) * 2)}), char(2), {_literal(chr(92) + chr(34))})"


def json_text(printed: str) -> str:
    """ECMAScript JSON text from ``to_json`` output (pass a column: it is read often)."""
    return f"case when {is_suspect(printed)} then {reprint(printed)} else {printed} end"


def is_numeric(kind: str) -> str:
    return f"({kind} in ('BIGINT', 'DOUBLE', 'FLOAT') or startswith({kind}, 'DECIMAL'))"


def double_from(value: str, kind: str) -> str:
    """The DOUBLE of a JSON number; NULL for every other type.

    Reading a VARIANT as another type than its own builds a cast for each row, so numbers are read as
    what they are.
    """
    return f"""case when {kind} = 'BIGINT' then cast(try_variant_get({value}, '$', 'bigint') as double)
        when startswith({kind}, 'DECIMAL') then try_cast(to_json({value}) as double)
        when {kind} in ('DOUBLE', 'FLOAT') then try_variant_get({value}, '$', 'double') end"""


def _array_text(printed: str) -> str:
    """Items joined by commas at every depth; objects as ``[object Object]``, null as nothing.

    Walks the tokens of the JSON text with the number of objects that are open.
    """
    masked = f"replace(replace({printed}, {_literal(chr(92) * 2)}, char(1)), {_literal(chr(92) + chr(34))}, char(2))"
    unmasked = f"replace(replace(tok, char(1), {_literal(chr(92) * 2)}), char(2), {_literal(chr(92) + chr(34))})"
    plain = f"""case when startswith(tok, '"') then try_variant_get(parse_json({unmasked}), '$', 'string')
        when tok rlike '^-?[0-9]' then {number_text("try_cast(tok as double)")}
        else tok end"""
    return f"""aggregate(regexp_extract_all({masked}, {_literal(_TOKEN)}, 1), named_struct('depth', 0, 'out', ''),
        (s, tok) -> case
            when tok = '{{' then named_struct('depth', s.depth + 1, 'out', if(s.depth = 0, concat(s.out, '[object Object]'), s.out))
            when tok = '}}' then named_struct('depth', s.depth - 1, 'out', s.out)
            when s.depth > 0 or tok in ('[', ']', 'null') then s
            else named_struct('depth', s.depth, 'out', concat(s.out, {plain})) end,
        s -> s.out)"""


def string_text(value: str, kind: str, text: str) -> str:
    """What string concatenation makes of a JSON value with this type and JSON text."""
    return f"""case when {kind} = 'STRING' then try_variant_get({value}, '$', 'string')
        when startswith({kind}, 'OBJECT') then '[object Object]'
        when startswith({kind}, 'ARRAY') then {_array_text(text)}
        else {text} end"""


def number_from(value: str, kind: str) -> str:
    """Numeric conversion of a JSON value; NULL where it is no number."""
    text = f"""case when {kind} = 'STRING' then trim(try_variant_get({value}, '$', 'string'))
        when startswith({kind}, 'ARRAY') then {_array_text(f'to_json({value})')} end"""
    decimal = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    return f"""case when {is_numeric(kind)} then {double_from(value, kind)}
        when {kind} = 'BOOLEAN' then try_variant_get({value}, '$', 'double')
        when ({text}) = '' then 0D
        when ({text}) rlike '{decimal}' then try_cast({text} as double) end"""


def is_truthy(value: str, kind: str) -> str:
    """False for NULL, empty string, zero and false; true for anything else."""
    return f"""coalesce(case when {kind} = 'STRING' then try_variant_get({value}, '$', 'string') != ''
        when {kind} = 'BOOLEAN' then try_variant_get({value}, '$', 'boolean')
        when {is_numeric(kind)} then try_variant_get({value}, '$', 'double') != 0
        when {kind} is not null then {kind} != 'VOID' end, false)"""
