"""Training-data operators: decontamination, toxicity, deduplication, quality,
token output, language-model scoring, chat formatting, mixing and line dedup.

Nothing else in the library imports this subpackage.
"""
