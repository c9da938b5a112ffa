"""The queries of this package, each with the SQL that checks it where SQL can express it."""

from gameline.llm import (arrow_ids, banded_jaccard, factor_machine, importance, mixing, packing, radix_dedup, secret_scan, subword_toxicity,
                          suffix_tree, token_cache, treap_search, va_file)

ALL = {}
for _part in (mixing, suffix_tree, subword_toxicity, va_file, radix_dedup, token_cache, arrow_ids, factor_machine, packing, banded_jaccard,
              treap_search, secret_scan, importance):
    ALL.update(_part.QUERIES)
