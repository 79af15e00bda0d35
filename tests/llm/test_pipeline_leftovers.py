"""What a stage of the pipeline leaves behind: on disk, and in the driver's memory."""

import os
import time
import tracemalloc

import numpy as np

from logweir.llm import ngram_join, toxicity
from logweir.llm.chunks import stored
from logweir.session import shared_folder


def test_join_leaves_no_candidates(spark):
    before = set(os.listdir(shared_folder(spark)))
    rows = [(i, " ".join(f"w{k}" for k in range(i // 2, i // 2 + 60))) for i in range(40)]
    kept = ngram_join.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]
    left = {name.split("-")[0] for name in set(os.listdir(shared_folder(spark))) - before}
    assert left == {"join", "sets", "classes", "roots"}


def test_shuffle_files_go_with_the_write(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    held = stored(spark.range(1000).repartition(5, "id"), "some")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert held.count() == 1000


def test_counting_terms_copies_little():
    rng = np.random.default_rng(1)
    owner = np.repeat(np.arange(4000, dtype=np.int32), 1000)
    flat = rng.integers(0, 20_000, len(owner)).astype(np.int32)
    y = (np.arange(4000) % 3 == 0).astype(float)
    flat[(y[owner] > 0) & (flat < 20)] = 7
    tracemalloc.start()
    found = toxicity.telling_columns(owner, flat, y, 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 7 in found
    # Two counts of all columns and the pieces; 29 MB, 44 MB with whole copies in 64 bits.
    assert most < 36e6, most
