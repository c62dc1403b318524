"""The report's types."""

from pyspark.sql import types as T

_L, _S, _B, _D = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType()

SPAN = T.StructType([T.StructField("start", _L), T.StructField("end", _L)])
FINDING = T.StructType(
    [
        T.StructField("rule_id", _S), T.StructField("span", SPAN), T.StructField("snippet", _S),
        T.StructField("snippet_truncated", _B), T.StructField("container", _S), T.StructField("topic_term", _B),
    ]
)
CLASS_DENSITY = T.StructType(
    [
        T.StructField("hits", _L), T.StructField("residual_hits", _L), T.StructField("per_1k_words", _D),
        T.StructField("residual_per_1k_words", _D),
    ]
)
DENSITIES = T.StructType([T.StructField(c, CLASS_DENSITY) for c in ("spike", "background", "individual")])
STATS = T.StructType([T.StructField("word_count", _L), T.StructField("byte_len", _L), T.StructField("densities", DENSITIES)])
REPORT = T.StructType(
    [T.StructField(c, T.ArrayType(FINDING)) for c in ("paste_residue", "quality_patterns", "injection_patterns")]
    + [T.StructField("stats", STATS)]
)
FLAT = T.StructType(
    [
        T.StructField("category", _S), T.StructField("rule_id", _S), T.StructField("class", _S),
        T.StructField("span_start", _L), T.StructField("span_end", _L), T.StructField("snippet", _S),
        T.StructField("snippet_truncated", _B), T.StructField("container", _S), T.StructField("topic_term", _B),
    ]
)
OCCURRENCE = T.StructType([T.StructField("path", _S), T.StructField("span", SPAN), T.StructField("container", _S)])
SHARED = T.StructType(
    [T.StructField("snippet", _S), T.StructField("snippet_truncated", _B), T.StructField("occurrences", T.ArrayType(OCCURRENCE))]
)
BUNDLE_FILE = T.StructType([T.StructField("path", _S), T.StructField("report", REPORT)])
BUNDLE = T.StructType([T.StructField("files", T.ArrayType(BUNDLE_FILE)), T.StructField("cross_file_duplication", T.ArrayType(SHARED))])
HIT = T.StructType([T.StructField("rule_id", _S), T.StructField("s", _L), T.StructField("e", _L)])
