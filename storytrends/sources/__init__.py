"""Readers of story files, word tables, comment dumps and saved models."""

from .store import read_months, write_months
from .stories import comment_rows, in_period, period_glob, read_comments, read_split_comments, read_stories
from .words import load_word2vec, read_tokenized, read_topic_words, read_word_vectors, stop_words, word_vectors_of

__all__ = [
    "comment_rows",
    "in_period",
    "load_word2vec",
    "period_glob",
    "read_comments",
    "read_months",
    "read_split_comments",
    "read_stories",
    "read_tokenized",
    "read_topic_words",
    "read_word_vectors",
    "stop_words",
    "word_vectors_of",
    "write_months",
]
