"""Operators of a large training-data pipeline; nothing else in the library imports this package."""

from filinglens.llm import exact, languages, licenses, near, negatives, packing, quality, ranked, regions, repeats, surrogates, toxicity, unigram

MODULES = [exact, languages, licenses, near, negatives, packing, quality, ranked, regions, repeats, surrogates, toxicity, unigram]
