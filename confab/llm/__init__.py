"""Operators for preparing large text corpora for language-model training.

Each operator lives in its own module and keeps a general interface; ``queries``
holds the thin ``opN_<name>`` queries built on them.
"""
