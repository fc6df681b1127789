"""Content-addressed ids: the first 16 hex digits of the SHA-256 of compact JSON with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in the order of their names, nulls included; control characters as lower-case escapes."""
    raw = F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})
    # An escaped backslash never starts another escape: between those, the escapes can be replaced as text.
    parts = F.split(raw, r"\\\\", -1)

    def lower(part: Column) -> Column:
        for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
            part = F.replace(part, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
        return part

    return F.when(raw.rlike(r"\\u00[01][A-F]"), F.array_join(F.transform(parts, lower), "\\\\")).otherwise(raw)


def node_id(kind: str, **fields: Column) -> Column:
    return F.substring(F.sha2(canonical_json(type=F.lit(kind), **fields), 256), 1, 16)


def memory_id(index: Column) -> Column:
    return node_id("memory", memory_index=index)


def turn_id(memory: Column) -> Column:
    return node_id("turn", memory_id=memory)


def segment_id(turn: Column, index: Column) -> Column:
    return node_id("utterance_segment", turn_id=turn, segment_index=index)


def ngram_id(segment: Column, kind: Column, text: Column) -> Column:
    return node_id("ngram", segment_id=segment, ngram_kind=kind, normalized_text=text)


def entity_id(form: Column, kind: Column) -> Column:
    return node_id("entity", canonical_form=form, entity_type=kind)


def claim_id(subject: Column, predicate: Column, object_id: Column, literal: Column) -> Column:
    return node_id("claim", subject_id=subject, predicate=predicate, object_id=object_id, object_literal=literal)


def preference_id(holder: Column, polarity: Column, target_id: Column, literal: Column) -> Column:
    return node_id("preference", holder_id=holder, polarity=polarity, target_id=target_id, target_literal=literal)


def anchor_id(iso: Column) -> Column:
    return node_id("time_anchor", iso_timestamp=iso)
