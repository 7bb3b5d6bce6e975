"""The operator language: ``=exact 'include ^prefix suffix$ !inverse`` with AND by space and OR by ``|``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import TRIMMED

#: Kind, its quoted form and its plain form, in the order in which they are tried.
FORMS = (
    ("exact", r'="(.*)"', r"=(.*)"),
    ("include", r"'\"(.*)\"", r"'(.*)"),
    ("prefix", r'\^"(.*)"', r"\^(.*)"),
    ("inverse-prefix", r'!\^"(.*)"', r"!\^(.*)"),
    ("inverse-suffix", r'!"(.*)"\$', r"!(.*)\$"),
    ("suffix", r'"(.*)"\$', r"(.*)\$"),
    ("inverse-exact", r'!"(.*)"', r"!(.*)"),
    ("fuzzy", r'"(.*)"', r"(.*)"),
)

_QUOTED = [(kind, re.compile(quoted)) for kind, quoted, _ in FORMS]
_PLAIN = [(kind, re.compile(plain)) for kind, _, plain in FORMS]

# A term: marks without space or quote, then either a quoted body, which ends at a quote that is
# followed by an optional $ and a space or the end, or all up to the next space.  An unclosed
# quote takes the rest.
_TERM = re.compile(r'[^ "]*"(?s:.*?)(?:"\$?(?= |\Z)|\Z)|[^ ]+')


@dataclass(frozen=True)
class Term:
    kind: str
    text: str

    @property
    def inverse(self) -> bool:
        return self.kind.startswith("inverse")


def split_terms(group: str) -> list[str]:
    return _TERM.findall(group)


def _term(raw: str) -> Term | None:
    """Quoted forms of all kinds first; an empty capture is no match; line feeds match no form."""
    for forms in (_QUOTED, _PLAIN):
        for kind, form in forms:
            if (found := form.fullmatch(raw)) and found[1]:
                return Term(kind, found[1])
    return None


def parse_extended(query: str) -> list[list[Term]]:
    """OR groups of AND terms; ``\\|`` is a plain pipe.  A group without a usable term matches nothing."""
    groups = re.split(r"(?<!\\)\|", query)
    trimmed = [g.replace("\\|", "|").strip(TRIMMED) for g in groups]
    return [[t for raw in split_terms(g) if raw.strip(TRIMMED) and (t := _term(raw))] for g in trimmed]
