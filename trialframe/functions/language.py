"""What a statement says beside its numbers, in Python; ``columns`` has the same for columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from . import patterns as P
from .literals import grade_after, one_spelling


def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.IGNORECASE)


_TEMPORAL = tuple(map(_compiled, P.TEMPORAL))
_REPETITION = _compiled(P.REPETITION)
_CUES = tuple((_compiled(pattern), domain) for pattern, domain in P.DOMAIN_CUES)


def plain_spelling(source: str | None) -> str:
    return grade_after(one_spelling((source or "").strip()))


def temporal(text: str) -> str | None:
    """All temporal phrases, pattern by pattern, each once."""
    return "; ".join(dict.fromkeys(m[0].strip() for pattern in _TEMPORAL for m in pattern.finditer(text))) or None


def repetition(text: str) -> str | None:
    found = _REPETITION.search(text)
    return found[0].strip() if found else None


def domains(aliases: dict[str, str]) -> Callable[[str | None, str | None, bool | None], str]:
    """A function that tells a domain by the longest alias that entity and source mention, else by cue words."""
    known = [(a, d) for a, d in sorted(aliases.items(), key=lambda x: -len(x[0])) if d in P.DOMAINS]
    named = [(_compiled(rf"(?<!\w){re.escape(a)}(?!\w)"), d) for a, d in known]
    some = _compiled(r"(?<!\w)(?:" + "|".join(re.escape(a) for a, _ in known) + r")(?!\w)") if known else None

    def domain(entity: str | None, source: str | None, compared: bool | None) -> str:
        text = f"{entity or ''} {source or ''}".lower()
        if some and some.search(text):
            return next(d for pattern, d in named if pattern.search(text))
        return next((d for pattern, d in _CUES if pattern.search(text) or compared and d == "measurement"), "observation")

    return domain


#: What validation looks for, by name.
SAID = {
    "comparison": P.COMPARISON_LANGUAGE,
    "negation": P.NEGATION_LANGUAGE,
    "not_due_to": P.NOT_DUE_TO,
    "unit": P.COMPARISON_WITH_UNIT,
    "temporal": P.TEMPORAL_LANGUAGE,
    "repetition": P.REPETITION_LANGUAGE,
    "compound": P.COMPOUND_LANGUAGE,
}
_SAID = {name: _compiled(pattern) for name, pattern in SAID.items()}


def said(source: str | None) -> dict[str, bool]:
    return {name: bool(pattern.search(source or "")) for name, pattern in _SAID.items()}
