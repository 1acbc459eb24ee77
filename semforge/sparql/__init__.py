"""A read-only SPARQL subset, compiled to DataFrame joins: text to tokens, tokens to algebra, algebra to a plan."""

from semforge.sparql.parser import SparqlError, parse
from semforge.sparql.plan import ask, select

__all__ = ["SparqlError", "ask", "parse", "select"]
