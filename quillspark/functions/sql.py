"""The report as functions of Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """Register ``text_findings(text)``, a table function, for interactive queries.

    ``SELECT d.doc_id, f.* FROM docs d, LATERAL text_findings(d.text) f``; a second
    argument, an array of topic terms, labels the findings that are one of them.
    """
    from quillspark.functions.scan import find

    @F.udtf(
        returnType="category string, rule_id string, class string, span_start bigint, span_end bigint, snippet string, "
        "snippet_truncated boolean, container string, topic_term boolean"
    )
    class TextFindings:
        def eval(self, text: str, allow: list = ()):
            yield from (tuple(f) for f in find(text or "", [a for a in allow or () if a is not None]))

    spark.udtf.register("text_findings", TextFindings)
