"""Content hashes, deduplication keys and deterministic identifiers, as SQL text."""

from __future__ import annotations

from .ecma import is_truthy, json_text, string_text

# The separator between hashed parts, and the four nibbles an
# RFC 4122 variant position may hold.
SEPARATOR = "|"
VARIANT_NIBBLES = "89ab"


def content_hash(printed: str) -> str:
    """SHA-256 of the canonical JSON text, from a column holding ``to_json`` output."""
    return f"sha2({json_text(printed)}, 256)"


def dedup_key(
    provider: str, provider_id: str, id_kind: str, id_text: str, occurred_at_text: str, model: str, user: str, payload: str
) -> str:
    """Identity hash of an event; cost and token counts never take part.

    A usable provider id decides alone.  Otherwise time, model, user and the hash
    of the content do, where the content is the (falsy) id if there is one and the
    whole payload if there is none.  ``id_text`` is the text of an id that is a JSON string, else NULL.
    """
    truthy = is_truthy(provider_id, id_kind)
    # Printed inside the rare branch, so that rows with a usable id never pay for it.
    payload_hash = f"transform(array(to_json({payload})), q -> {content_hash('q')})[0]"
    usual = f"concat_ws('{SEPARATOR}', {provider}, {id_text})"
    composite = f"""concat_ws('{SEPARATOR}', {provider}, coalesce({occurred_at_text}, ''), coalesce({model}, ''),
        coalesce({user}, ''), coalesce(if({id_kind} != 'VOID', sha2(idt, 256), null), {payload_hash}))"""
    by_id = f"concat_ws('{SEPARATOR}', {provider}, {string_text(provider_id, id_kind, 'idt')})"
    general = f"""transform(transform(array(to_json({provider_id})), p -> {json_text('p')}),
        idt -> sha2(if({truthy}, {by_id}, {composite}), 256))[0]"""
    return f"case when {id_text} != '' then sha2({usual}, 256) else {general} end"


def uuid_from(seed_hash: str) -> str:
    """Version-4-shaped UUID text from the SHA-256 hex digest of its seed."""
    h = seed_hash
    nibble = f"cast(conv(substr({h}, 17, 1), 16, 10) as int) % 4 + 1"
    return f"""concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), concat('4', substr({h}, 14, 3)),
        concat(substr('{VARIANT_NIBBLES}', {nibble}, 1), substr({h}, 18, 3)), substr({h}, 21, 12))"""
