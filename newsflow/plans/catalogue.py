"""Imports every module that registers queries."""

from newsflow.plans import analysis, events, ingest, ops, streams  # noqa: F401
