import tracemalloc

import numpy as np
import pyarrow as pa

from kindred.operators import text_sketch


class Frame:
    """Stands for a DataFrame and runs what it is given over one batch."""
    schema = {"id": type("F", (), {"dataType": type("T", (), {"simpleString": staticmethod(lambda: "bigint")})})}

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return list(run([self.batch]))


def test_digests_are_held_by_bytes():
    d = text_sketch._Digests()
    for i in range(20_000):
        d[f"{i}" + "a" * 5000]
    assert sum(map(len, d)) < 40 << 20


def test_words_of_one_text_at_a_time(spark):
    letters = np.random.default_rng(1).integers(97, 123, (3000, 300, 7), np.uint8)
    texts = [" ".join(bytes(w).decode() for w in t) for t in letters]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    tracemalloc.start()
    got = text_sketch.word_sketches(Frame(batch), "id", "text")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == len(texts)
    assert peak < 60 << 20
