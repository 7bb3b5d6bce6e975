"""Lodestone: ranked, typo-tolerant record search as Spark plans."""

from .engine import Index, SearchEngine, fuzzy_search, match, ordered_on_driver
from .errors import SearchError
from .functions.bitap import Found, ScanOptions
from .operators.batch import fuzzy_join, search_many, triage, without_partner
from .options import FEATURES, MAX_BITS, SearchOptions, register_option
from .plans.extended import parse_extended
from .plans.keys import Key, KeySet
from .plans.logical import parse_logical
from .plans.matchers import clear_registry, compile_query, register, registered
from .sources.index import create_index, load_index, parse_index, save_index
from .sources.records import infer_keys, load_records

__version__ = "0.1.0"

__all__ = [
    "FEATURES",
    "MAX_BITS",
    "Found",
    "Index",
    "Key",
    "KeySet",
    "ScanOptions",
    "SearchEngine",
    "SearchError",
    "SearchOptions",
    "clear_registry",
    "compile_query",
    "create_index",
    "fuzzy_join",
    "fuzzy_search",
    "infer_keys",
    "load_index",
    "load_records",
    "match",
    "ordered_on_driver",
    "parse_extended",
    "parse_index",
    "parse_logical",
    "register",
    "register_option",
    "registered",
    "save_index",
    "search_many",
    "triage",
    "without_partner",
]
