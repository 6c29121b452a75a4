"""Seeded random numbers as SQL text: a function of seed and row alone, so they don't depend on partitions."""

from __future__ import annotations


def uniform(seed: int, *parts: str, duck: bool = False) -> str:
    """A number in (0, 1) with 53 bits, from the first 52 of the MD5 of the seed and the columns; `duck`: in DuckDB's words."""
    kind = "varchar" if duck else "string"
    text = f"md5(concat('{seed}'" + "".join(f", '-', cast({p} AS {kind})" for p in parts) + "))"
    whole = f"cast('0x' || substring({text}, 1, 13) AS bigint)" if duck else f"cast(conv(substring({text}, 1, 13), 16, 10) AS bigint)"
    return f"(({whole} + 0.5e0) / 4503599627370496e0)"
