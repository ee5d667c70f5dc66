"""Operators for preparing large text corpora.  Nothing outside this
subpackage imports it; its queries live in :mod:`gleaner.llm.queries`."""
