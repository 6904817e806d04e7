"""Dialogue and utterance analytics as Spark DataFrame operators."""
