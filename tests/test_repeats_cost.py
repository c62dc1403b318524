"""Only shingles that a text repeats leave its row."""

from collections import Counter

from quillspark.operators.repeats import repeating_texts


def test_only_repeated_shingles_leave_a_row(spark):
    told = "we walked all day along the old north road to town"
    data = [(1, f"{told} and then {told} again " + " ".join(f"w{k}" for k in range(500))), (2, " ".join(f"w{k}" for k in range(90))), (3, None), (4, "a b")]
    got = {r.doc_id: r.again for r in repeating_texts(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert list(got) == [1]
    assert sorted(x.c for x in got[1]) == [*range(4), *range(13, 17)]
    assert set(Counter(x.h for x in got[1]).values()) == {2}
