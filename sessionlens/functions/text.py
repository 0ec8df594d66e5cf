"""Text helpers as SQL text.  White space means the Unicode set below, not only blanks."""

from __future__ import annotations

# Fixed value: the characters that count as white space when text is split or stripped.
SPACE = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def is_blank(text: str) -> str:
    """True when nothing but white space is there."""
    return f"(not regexp_like({text}, r'[^{SPACE}]'))"


def word_count(text: str) -> str:
    return f"cast(regexp_count({text}, r'[^{SPACE}]+') as bigint)"


def mentions(text: str, word: str) -> str:
    """Case-insensitive substring test; missing text mentions nothing."""
    return f"contains(lower(coalesce({text}, '')), '{word}')"


def token_estimate(text: str) -> str:
    """1.3 tokens per word, rounded half-even, at least one."""
    return f"greatest(1L, cast(rint({word_count(text)} * 1.3D) as bigint))"
