"""Small tables for the tests of this folder."""

from __future__ import annotations


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def odd_rows():
    """Null, empty, blank, very long, repeated and tied rows."""
    story = "The quick fox ran over the lazy dog near a river. It was a very long day for all of them there. "
    return [
        (1, story, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "en", None),
        (5, story, "en", "a"), (5, story, "en", "a"), (6, "word", "de", "b"), (None, story, "en", "a"),
        (7, "der Hund und die Katze sind nicht im Haus. " * 3, "de", "b"), (8, "...!!! 123 \n\n", "de", "c"),
        (9, "x" * 200_000, "en", "a"), (10, "la vida es de los que no la temen " * 4000, "es", "c"),
        (11, "É è ü ß non breaking", "fr", "c"), (12, "a b", None, None), (13, "A B", None, None),
    ]
