"""sievetext: keep the small part of a large text collection that matters.

The names are loaded when they are first used: a Python worker that imports one module of this
package holds that module and what it needs, and nothing else.
"""

from importlib import import_module

_HOMES = {
    "functions.encoders": ("HashEncoder", "ModelEncoder", "VectorTable", "register_encoder"),
    "operators.intents": (
        "build_filter_table", "expand_fields", "expand_queries", "route_requests", "split_description",
        "validate_requests",
    ),
    "operators.matching": ("best_match", "match_summary", "reduction", "score_all", "top_k_per_category"),
    "operators.vectors": ("centroid_filters", "centroid_sum", "embed", "embed_filters", "masked_mean_pool"),
    "plans.trim": ("match_archive", "match_archive_to_lines", "trim_against", "trim_corpus", "trim_vectors"),
    "sources.bundle": ("bundle_errors", "read_bundle", "scan_bundle", "write_bundle"),
    "sources.datasource": ("bundle_rows", "register_bundle_source"),
    "sources.jobs": ("archive_inputs", "find_inputs", "scan_data_csv", "scan_filter_csv", "scan_filter_errors"),
    "sources.sinks": ("write_filters", "write_lines", "write_matches", "write_normalized"),
    "streaming.trim": ("trim_stream",),
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names}

__all__ = list(_HOME_OF)


def __getattr__(name: str):
    if name not in _HOME_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    found = globals()[name] = getattr(import_module(f".{_HOME_OF[name]}", __name__), name)
    return found


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
