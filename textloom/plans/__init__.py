"""Queries with their SQL; importing the package registers them all."""

from textloom.plans import catalogue, corpora, learned, measures, modelled, readers, spaces, texts  # noqa: F401
