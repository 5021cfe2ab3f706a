"""Spark jobs that turn raw video-playback events into session tables.

Layers, each a plain ``DataFrame -> DataFrame`` function unless it says otherwise:

``functions``  column expressions (orderings, state mapping, contract rules)
``operators``  landing, parsing, validation, dedup, session folding, quality
``sources``    broker and table readers
``sinks``      append streams and the keyed upsert
``plans``      compositions: batch medallion, incremental refresh, query catalog
``streaming``  Structured Streaming jobs around the same operators
"""
