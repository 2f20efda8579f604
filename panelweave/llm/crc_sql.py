"""SQL text of the CRC-32 of a string, for the SQL counterparts."""

from __future__ import annotations


def _table() -> str:
    values = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        values.append(str(n))
    return "[" + ", ".join(values) + "]::BIGINT[]"


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of the UTF-8 bytes of ``text`` (an expression)."""
    parts = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"xor(c >> 8, list_extract({_table()}, xor(c & 255, b) + 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {parts}), lambda c, b: {step}), 4294967295::BIGINT)"
