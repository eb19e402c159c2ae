"""Deterministic stand-in models for tests and checked queries.

Each is a factory returning ``fn(prompts, params) -> responses``; the output
is a plain function of the whole prompt text, so SQL can recompute it.
"""

from __future__ import annotations


def length_model():
    """Answers with the number of characters of the prompt (padded with
    whitespace to exercise the response strip)."""
    def fn(prompts, params):
        return [None if p is None else f"  Final Answer: {len(p)}\n" for p in prompts]
    return fn


def letter_count_model(letter: str = "e"):
    """Answers with how often ``letter`` occurs in the prompt."""
    def factory():
        def fn(prompts, params):
            return [None if p is None else f"#### {p.count(letter)}" for p in prompts]
        return fn
    factory.__qualname__ = f"letter_count_model[{letter}]"
    return factory


def failing_model(marker: str = "@"):
    """Like :func:`length_model`, but a batch holding ``marker`` raises."""
    def factory():
        inner = length_model()

        def fn(prompts, params):
            if any(p is not None and marker in p for p in prompts):
                raise ValueError(f"prompt contains {marker!r}")
            return inner(prompts, params)
        return fn
    factory.__qualname__ = f"failing_model[{marker}]"
    return factory


def settings_model():
    """Answers with the settings it was called with."""
    def fn(prompts, params):
        text = " ".join(f"{k}={params[k]}" for k in sorted(params))
        return [text] * len(prompts)
    return fn
