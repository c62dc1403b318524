"""What the pipeline's steps leave in an executor for the next one."""

import public_tokenizers

import corpus_pipeline
from quillspark.llm import packing
from quillspark.llm.common import trim_executors
from quillspark.llm.memo import Memo


def test_a_tokenizer_keeps_two_generations_of_words_in_all(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 50)
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"w{'abcdefghij'[k % 10] * (1 + k // 10)} un{'klmnopqrst'[k % 10] * (1 + k // 10)}, don't" for k in range(300))
    assert w.ids(text) == w._whole(text)
    assert sum(len(m.young) + len(m.old) for m in vars(w).values() if isinstance(m, Memo)) <= 100


def test_each_stage_first_has_executors_give_back_their_heaps(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(corpus_pipeline, "trim_executors", asked.append)
    docs = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, source string, n_chars long")
    assert corpus_pipeline.drop_lines(spark, docs, "").collect() == docs.collect()
    assert asked == [spark]


def test_a_driver_that_is_the_executor_is_left_alone(spark):
    assert trim_executors(spark) == 0
