"""All queries of this package: importing the operator modules fills the registry."""

from rainloom.llm import forest, jaccard, language, lexical, packing, pii, pivots, slots, tokens, toxicity, trie, warc  # noqa: F401
from rainloom.llm.common import ORACLES, QUERIES  # noqa: F401
