"""Named queries of this package and their equivalent SQL."""

from limpid.llm import (
    decontaminate, graph_search, language, packing, periodic_runs, personal_data, pitman_yor, prefix_trie, sharding, simhash,
    substrings, toxicity, url_lists,
)

# in the order of their numbers
_PARTS = (decontaminate, sharding, toxicity, packing, language, graph_search, pitman_yor, url_lists, substrings, simhash,
          prefix_trie, personal_data, periodic_runs)

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in getattr(part, "SQL", {}).items()}
