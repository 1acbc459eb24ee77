"""Quads: projection, provenance, closure, shapes, Turtle and sinks.

A quad is (graph, subject, predicate, object_kind, object, datatype, language): object is an IRI, or a literal's text.
"""
