"""Search options.  Names may be given in snake_case or camelCase."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace
from typing import Any

#: Widest pattern that one scan takes; longer ones are cut into pieces of this length.
MAX_BITS = 32

#: Switches of whole search modes.
FEATURES = {"extended": True, "logical": True, "token": True}

_plugin_options: set[str] = set()


def register_option(name: str) -> None:
    """Let a plugin matcher read an option of its own from ``SearchOptions.extra``."""
    _plugin_options.add(name)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


@dataclass(frozen=True)
class SearchOptions:
    is_case_sensitive: bool = False
    ignore_diacritics: bool = False
    include_score: bool = False
    keys: Sequence[Any] = ()
    should_sort: bool = True
    sort_fn: Callable | Sequence | None = None
    include_matches: bool = False
    find_all_matches: bool = False
    min_match_char_length: int = 1
    location: int = 0
    threshold: float = 0.6
    distance: int = 100
    use_extended_search: bool = False
    use_token_search: bool = False
    tokenize: Any = None
    token_match: str = "any"
    get_fn: Callable | None = None
    ignore_location: bool = False
    ignore_field_norm: bool = False
    field_norm_weight: float = 1.0
    strict_js_pow: bool = False
    extra: Mapping[str, Any] | None = None

    def __post_init__(self):
        if self.token_match not in ("any", "all"):
            raise ValueError(f"token_match must be 'any' or 'all', not {self.token_match!r}")

    @classmethod
    def coerce(cls, given: SearchOptions | Mapping[str, Any] | None = None, **more: Any) -> SearchOptions:
        if given is None:
            given = {}
        if isinstance(given, SearchOptions):
            return replace(given, **more) if more else given
        if not isinstance(given, Mapping):
            raise TypeError(f"options must be a mapping or SearchOptions, not {type(given).__name__}")
        known, extra = {f.name for f in fields(cls)} - {"extra"}, {}
        values = {}
        for name, value in {**given, **more}.items():
            if (own := snake(name)) in known:
                values[own] = value
            elif name in _plugin_options:
                extra[name] = value
            else:
                raise TypeError(f"Unknown search option: {name}")
        return cls(**values, extra=extra or None)

    def replace(self, **changes: Any) -> SearchOptions:
        return replace(self, **changes)
