"""Spark-native analytics for recorded terminal-session logs.

Every operator is a ``DataFrame -> DataFrame`` function over the tables in
:mod:`shelltrace.schema`; the same definitions serve batch and streaming.
"""
