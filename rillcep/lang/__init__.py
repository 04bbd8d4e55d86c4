"""The query language: lexer, syntax tree and recursive-descent parser."""

from rillcep.lang.parser import parse

__all__ = ["parse"]
