"""Training-data operators: packing, deduplication, language ID, token output, WARC, language-model scoring, BPE, quality rules,
alignment of tokenizers, spelling variants, toxicity.

Nothing else in the library imports this subpackage.
"""
