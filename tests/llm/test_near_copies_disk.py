"""That the near-duplicate stage holds the shuffle files of one job at a time, not those of all its rounds."""

import os
import random
import time

import pytest

from glossator.llm import near_copies as nc
from glossator.llm.common import FREE_SHUFFLES, spent_shuffles_removed
from tests.llm.test_near_copies import edited, kept_model

DOC = "doc_id long, text string"


def shuffles(spark):
    """The shuffles of which there are files."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name.split("_")[1] for d in dirs for _, _, files in os.walk(d) for name in files if name.startswith("shuffle_")}


def test_rounds_leave_no_shuffle_files(spark):
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(12)]
    texts += [edited(r, t, k) for t in texts for k in (1, 3)]
    docs, before = spark.createDataFrame(list(enumerate(texts)), DOC), shuffles(spark)
    out = nc.near_copy_components(docs)
    end = time.time() + 10  # files are removed beside the next job
    while (left := shuffles(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert {x.component_id for x in out.collect()} == {x.component_id for x in out.collect()} == kept_model(texts)


def test_setting_is_put_back(spark):
    assert spark.conf.get(FREE_SHUFFLES, None) is None
    with pytest.raises(ZeroDivisionError), spent_shuffles_removed(spark):
        assert spark.conf.get(FREE_SHUFFLES) == "true"
        1 / 0
    assert spark.conf.get(FREE_SHUFFLES, None) is None
    spark.conf.set(FREE_SHUFFLES, "false")
    try:
        with spent_shuffles_removed(spark):
            assert spark.conf.get(FREE_SHUFFLES) == "true"
        assert spark.conf.get(FREE_SHUFFLES) == "false"
    finally:
        spark.conf.unset(FREE_SHUFFLES)
