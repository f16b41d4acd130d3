"""Scratch tables of blocks that run side by side, and a vocabulary with blanks inside its tokens."""

import threading

from docengine.llm import packing
from docengine.llm.common import scratch, stored


def test_blocks_of_two_threads_keep_apart(spark):
    begun, ended, got = threading.Event(), threading.Event(), {}

    def short() -> None:
        begun.wait(60)
        with scratch(spark):
            got["short"] = stored(spark.range(5), "short")
        ended.set()

    other = threading.Thread(target=short)
    other.start()
    with scratch(spark):
        mine = stored(spark.range(7), "mine")
        begun.set()
        assert ended.wait(60)
        late = stored(spark.range(3), "late")
        assert mine.count() == 7 and late.count() == 3
        with scratch(spark):
            inner, stays = stored(spark.range(2), "inner"), stored(spark.range(4), "stays", stay=True)
        assert mine.count() == 7 and stays.count() == 4
    other.join()
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stays.inputFiles()[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda df: system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]))
    assert there(stays) and not any(map(there, (mine, late, inner, got["short"])))


def test_tokens_with_blanks_inside_are_encoded_alone():
    texts = ["the words of a text, and more words", "one\ntwo three", "", "a"]
    encoder = packing.Encoder(packing.default_tokenizer_path())
    want = [x.tolist() for x in encoder.encode(texts)]
    encoder.first[:] = True  # as if each token held a blank
    assert [x.tolist() for x in encoder.batch(texts)] == want
