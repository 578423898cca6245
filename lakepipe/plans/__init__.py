"""Plan display."""

from lakepipe.plans.explain import explain_text

__all__ = ["explain_text"]
