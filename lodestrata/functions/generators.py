"""Functions that turn one row into many, as table functions for lateral joins.

    generators.register(spark)
    spark.sql("SELECT d.doc_id, s.* FROM documents d, LATERAL sentences(d.text) s")

or `df.lateralJoin(generators.sentences(F.col("text").outer()))`. A table function has a schema of its own; it is given rows in
Arrow batches and keeps nothing between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+$")


@F.udtf(returnType="place int, start int, sentence string", useArrow=True)
class sentences:  # noqa: N801  used like a function
    """The sentences of a text: its stretches up to and with the next closing marks, the last one up to the end. place counts
    from 0, start is the code point at which the stretch begins; stretches of white space only are left out but not renumbered.
    A null or empty text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        for place, m in enumerate(_SENTENCE.finditer(text or "")):
            if m[0].strip(" \t\n\r\x0b\x0c"):
                yield place, m.start(), m[0]


@F.udtf(returnType="place int, left string, right string, distance int", useArrow=True)
class word_pairs:  # noqa: N801
    """Each word with each of the `reach` words after it: training pairs of one text. Null texts have none."""

    def eval(self, text: str, reach: int) -> Iterator[tuple]:
        words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        for i, a in enumerate(words):
            for k, b in enumerate(words[i + 1 : i + 1 + reach], 1):
                yield i, a, b, k


GENERATORS = {"sentences": sentences, "word_pairs": word_pairs}


def register(spark: SparkSession) -> None:
    """Name all generators in the session's SQL."""
    for name, f in GENERATORS.items():
        spark.udtf.register(name, f)
