"""Seams for models: language model, reranker, embedder. The defaults work offline and give the same results every time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import terms

#: (prompt, model) -> answer. It must be picklable: executors call it.
Complete = Callable[[str, str], str]


class ChatModel(Protocol):
    """A turn of a conversation: the answer's text and the tools it asks for, as {"name", "input"}."""

    def turn(self, messages: list[dict], tools: list[dict]) -> dict: ...


def silent(prompt: str, model: str) -> str:
    """The offline language model finds nothing."""
    return '{"entities": [], "relationships": []}'


def lexical_overlap(query: Column, text: Column) -> Column:
    """The offline reranker: the share of the query's distinct terms that the text has."""
    asked = F.array_distinct(terms(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(text))) / F.size(asked)).otherwise(0.0)
