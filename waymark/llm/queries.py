"""Queries of the training-data operators."""

from __future__ import annotations

from waymark.llm import q_bpe, q_credentials, q_frequency, q_langid, q_leakage, q_machine_made, q_syntax
from waymark.registry import Registry

LLM = Registry()
for part in (q_credentials, q_machine_made, q_syntax, q_frequency, q_bpe, q_leakage, q_langid):
    part.register(LLM)
