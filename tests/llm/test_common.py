"""What the operators share: batches by bytes, tables held by workers, the shared folder."""

import re
import time
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import common, subword


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def test_batches_are_cut_by_bytes():
    texts = ["a" * 300, None, "", "é" * 5000, "b" * 900, *["c" * 100] * 50]
    parts = list(common.cut(iter([batch(texts), batch([]), batch(["x"])]), 1000))
    assert [t for p in parts for t in p.column("text").to_pylist()] == [*texts, "x"]
    assert all(p.nbytes <= 1500 or p.num_rows == 1 for p in parts) and len(parts) > 6
    assert list(common.cut(iter([]))) == []


def test_workers_hold_one_operators_tables():
    made = []
    make = lambda name: lambda: made.append(name) or name
    assert [common.held("a", make("a")), common.held("a", make("a")), common.held("b", make("b")), common.held("a", make("a"))] == ["a", "a", "b", "a"]
    assert made == ["a", "b", "a"]
    run = common.pieces(lambda b: iter([b]))
    assert len(list(run(iter([batch(["x"])])))) == 1
    common.held("a", make("again"))
    assert made[-1] == "again"  # an operator that holds nothing starts by letting go
    one, two = common.lean(lambda t: t), common.lean(lambda a, b: (a, b))
    assert one.__code__.co_argcount == 1 and two(1, 2) == (1, 2)


def test_a_cluster_needs_a_shared_folder():
    conf = {}
    spark = lambda master: SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(spark(master))
    assert common.shared_dir(spark("local[2]")) == conf["spark.checkpoint.dir"]
    conf["spark.checkpoint.dir"] = "file:/shared/"
    assert common.shared_dir(spark("yarn")) == "file:/shared"


def test_names_that_are_not_taken():
    df = SimpleNamespace(columns=["T1", "t1_", "x"])
    assert common.unused(df, "t1") == "t1__" and common.unused(df, "y") == "y"


def test_the_driver_gives_back_what_its_jvm_keeps(spark):
    """Of native buffers every other one is freed, so the allocator has holes that it keeps by itself."""
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024
    kept, freed = jvm.java.util.ArrayDeque(), jvm.java.util.ArrayDeque()
    for _ in range(1000):
        kept.add(jvm.java.nio.ByteBuffer.allocateDirect(60_000))
        freed.add(jvm.java.nio.ByteBuffer.allocateDirect(60_000))
    freed.clear()
    for _ in range(4):  # the heap has its size, and the buffers are freed
        common.gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    before = held()
    common.free_shuffles(spark)
    assert held() < before - 30 and kept.size() == 1000


def test_words_of_many_texts_are_summed_in_blocks():
    rng = np.random.default_rng(3)
    words, n = [f"w{i}" for i in range(500)], 1_500_000
    at = rng.integers(0, 500, n)
    cuts = np.sort(rng.integers(0, n - 400_000, 3000))
    offsets = np.concatenate([[0, 0], cuts, [n, n]])  # empty texts at both ends, the last but one of 400,000 words
    model = subword.Subword(2, 2, 4, 1 << 12, 8, False)
    model.start()
    model.embed += rng.normal(0, 1, model.embed.shape).astype(np.float32)
    rows = model._of_words(words, model.embed).astype(np.float64)
    mean = np.stack([rows[at[a:b]].sum(0) / max(b - a, 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    tracemalloc.start()
    z = model.bags(words, at, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_allclose(z, mean @ model.out + model.bias, rtol=1e-6, atol=1e-6)
    assert peak < 80_000_000  # all at once: 144 MB
