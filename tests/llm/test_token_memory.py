"""That a task of the token writer holds the ids of few texts at a time, however many rows a batch has."""

import public_tokenizers

from glossator.llm import token_output as to

PATH = public_tokenizers.path("word_bpe_49k.json")


class Watched(to.ChunkEncoder):
    def encode(self, texts):
        assert sum(map(len, texts)) <= 5 << 20
        return super().encode(texts)


def watched(path):
    return Watched(path)


def test_writer_takes_batches_in_slices(spark, tmp_path, monkeypatch):
    texts = [f"text {i} " + "some words of it " * 120 for i in range(6000)]  # 12 MB in one batch
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (7000, None)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(to, "encoder", watched)
    manifest = to.write_tokens(docs, PATH, path=str(tmp_path / "out"), files=1)
    got = to.read_tokens(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *range(6000), 7000]
    want = to.ChunkEncoder(PATH).encode(["no id", *texts[:50]])
    assert [r.n_tokens for r in got[:51]] == [len(w) // 2 + 1 for w in want] and got[-1].n_tokens == 1
    m = manifest.first()
    assert (m.docs, m.least, m.most) == (6002, 0, 7000)
