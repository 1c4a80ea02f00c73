"""Where the public tokenizers' files are; a path parameter overrides it."""

from __future__ import annotations


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
