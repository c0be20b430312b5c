"""More streams, more languages, and the edges of operators called alone: nulls, repeats, ties, clashing columns,
very long texts."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glossator.llm import language as lang
from glossator.llm import media, mixing, simhash
from glossator.llm import token_output as to
from glossator.llm.repeats import repeats_digest

DOC = "doc_id long, text string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# --- streams --------------------------------------------------------------------------------------


def bits_of(data):
    return "".join(f"{b:08b}" for b in data)


def crc_of(bits):
    """The checksum by its definition, a bit at a time."""
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) != int(b) else 0)
    return crc


def frame(word, body_bits, covered):
    """A protected frame of this header whose checksum covers so many bits of its body."""
    h = media.parse_header(word)
    body = body_bits.ljust((h.size - 6) * 8, "0")
    head = struct.pack(">I", word)
    crc = crc_of(bits_of(head[2:]) + body[:covered])
    return head + struct.pack(">H", crc) + int(body, 2).to_bytes(h.size - 6, "big")


def header(version, layer, rate_index, sample_index, mode, extension=0):
    return 0x7FF << 21 | {1: 3, 2: 2, 25: 0}[version] << 19 | (4 - layer) << 17 | rate_index << 12 | sample_index << 10 | mode << 6 | extension << 4


@pytest.mark.parametrize(
    ("word", "covered"),
    [
        (header(1, 1, 10, 0, 0), 256),  # Layer I stereo: 4 bits for each of 32 bands and 2 channels
        (header(1, 1, 10, 0, 3), 128),
        (header(1, 1, 10, 0, 1, 2), 4 * (12 * 2 + 20)),  # joint from band 12 on
        (header(1, 2, 3, 2, 3), 38 + 2 * 12),  # Layer II, 32 kHz mono at 56 kbit/s has table a: see below
        (header(1, 2, 2, 2, 3), 38 + 2 * 12),  # 48 kbit/s: 2 bands of 4 bits, 10 of 3
        (header(1, 2, 1, 0, 3), 26 + 2 * 8),  # 44.1 kHz at 32 kbit/s: 2 bands of 4 bits, 6 of 3
        (header(2, 2, 8, 0, 3), 75 + 2 * 30),  # low rates: 4 bands of 4 bits, 7 of 3, 19 of 2
        (header(1, 2, 14, 0, 0), 2 * 94 + 2 * 2 * 30),  # stereo at 384 kbit/s: 11 of 4, 12 of 3, 7 of 2
        (header(1, 2, 14, 1, 0), 2 * 88 + 2 * 2 * 27),  # 48 kHz: 11 of 4, 12 of 3, 4 of 2
    ],
)
def test_checksums_of_all_layers(word, covered):
    if word == header(1, 2, 3, 2, 3):
        covered = 88 + 2 * 27
    good = frame(word, "1" * covered, covered)
    s = media.parse(good * 3)
    assert (len(s.offsets), s.checked, s.bad_crc) == (3, 3, 0)
    bad = bytearray(good * 3)
    bad[len(good) + 6 + covered // 8 - 1] ^= 1
    assert media.parse(bytes(bad)).bad_crc == 1


def plain(word, rest=b""):
    h = media.parse_header(word)
    return (struct.pack(">I", word) + rest).ljust(h.size, b"\0")


def test_delay_and_padding_are_no_sound():
    word = 0xFFFB9064
    xing = b"Xing" + struct.pack(">III", 15, 5, 417 * 6) + bytes(range(0, 200, 2)) + struct.pack(">I", 50) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    s = media.parse(plain(word, bytes(32) + xing) + plain(word) * 5)
    assert (s.delay, s.padding, len(s.offsets), s.samples) == (576, 1000, 5, 5 * 1152 - 1576)
    assert s.seconds == pytest.approx((5 * 1152 - 1576) / 44100)
    assert s.vbr[:3] == ("Xing", 5, 417 * 6) and s.vbr[3][50] == 100 * 417 * 6 // 256


def test_the_other_seek_table():
    word = 0xFFFB9064
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 417 * 6, 5, 3, 2, 2, 2) + struct.pack(">HHH", 417, 417, 208)
    s = media.parse(plain(word, bytes(32) + vbri) + plain(word) * 5)
    assert s.vbr == ("VBRI", 5, 417 * 6, [834, 1668, 2084]) and len(s.offsets) == 5


def test_tags_of_all_kinds():
    frames = plain(0xFFFB9064) * 3

    def tag(version, flags, body):
        return b"ID3" + bytes((version, 0, flags)) + media.syncsafe(len(body)) + body

    old = tag(2, 0, b"TT2" + (6).to_bytes(3, "big") + b"\0Older")
    assert media.parse(old + frames).tags == {"TT2": "Older"}
    named = b"TIT2" + struct.pack(">IH", 5, 0) + b"\0Name"
    assert media.parse(tag(3, 64, struct.pack(">IHI", 6, 0, 0) + named) + frames).tags == {"TIT2": "Name"}
    odd = b"TIT2" + struct.pack(">IH", 4, 0) + b"\0A\xff\0\xe0"
    assert media.parse(tag(3, 128, odd) + frames).tags == {"TIT2": "A\xff\xe0"}
    four = b"TIT2" + media.syncsafe(5) + b"\0\0" + b"\3\xc3\xa9ab"
    s = media.parse(tag(4, 64, media.syncsafe(6) + b"\1\0" + four) + frames)
    assert (s.tags, s.skipped, len(s.offsets)) == ({"TIT2": "éab"}, 0, 3)
    item = struct.pack("<II", 5, 0) + b"Artist\0" + b"Singer"[:5]
    ape = item + b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + bytes(8)
    s = media.parse(frames + ape + b"TAG" + b"Last".ljust(125, b"\0"))
    assert (s.tags, s.skipped, len(s.offsets)) == ({"Artist": "Singe", "title": "Last"}, 0, 3)


def test_free_bit_rate():
    word = 0xFFFB9064 & ~0xF000
    padded = [0, 1, 1, 0, 1]
    data = b"".join((struct.pack(">I", word | p << 9) + bytes([7] * (500 + p - 4))) for p in padded)
    s = media.parse(b"junk" + data)
    assert (len(s.offsets), s.skipped, [h.size for h in s.headers]) == (5, 4, [500 + p for p in padded])


def test_media_edges(spark):
    long = "ab ü" * 300_000
    rows = spark.createDataFrame([(None, "x", 1), (1, "x", 2), (1, "x", 3), (2, long, 4)], DOC + ", n_bytes int")
    got = [(r.doc_id, r.n_bytes, r.payload_bytes) for r in media.media_report(rows).collect()]
    n = len(long.encode())
    assert sorted(got, key=str) == sorted([(None, 1, 64), (1, 1, 64), (1, 1, 64), (2, n, n + -n % 64)], key=str)


# --- languages ------------------------------------------------------------------------------------


def test_three_hundred_languages(spark):
    r = random.Random(3)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    rows = []
    for k in range(300):
        own = alphabet[3 * k : 3 * k + 3]
        for j in range(6):
            rows.append((k * 6 + j, " ".join("".join(r.choice(own) for _ in range(6)) for _ in range(60)), f"l{k:03d}"))
    docs = spark.createDataFrame(rows, DOC + ", lang string")
    got = lang.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    learned = {f"l{i // 6:03d}" for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(learned) > 256
    assert all(x.lang_pred == x.lang for x in got if x.lang in learned)


def test_a_language_of_two_short_texts_is_learned(spark):
    english = ["the house by the river is old and the road is long", "a ship came over the sea with all its men", "what we have said is what we shall do"]
    rows = [(i, f"{english[i % 3]} {i}", "en") for i in range(90)]
    learned = [i for i in range(200, 230) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    other = ["xochitl tlazohtla quetzal", "nahuatl tepetl cuauhtli"]
    rows += [(i, t, "xx") for i, t in zip(learned, other, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang.language_report(docs).collect()}
    assert all(got[i][0] == "xx" and got[i][1] > 0.9 for i in learned)
    assert all(got[i][0] == "en" for i in range(90))


def plain_grams(text):
    """The n-grams of a text, by their definition."""
    points = "".join(c if c.isalpha() else " " for c in text.lower())
    spaced = " " + "".join(w + " " for w in points.split())
    return [spaced[i : i + lang.GRAM] for i in range(len(spaced) - lang.GRAM + 1)]


def gram_hash(gram):
    h = 0
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
        h ^= h >> 29
    return h


def test_language_counts_and_correction_by_plain_python(spark):
    """Members of each filter, rates, hits, corrected counts and scores, computed anew from the texts."""
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang.fit_languages(docs)
    rows = docs.collect()
    counts = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    share = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    top = Counter()
    for s in share.values():
        for g, x in s.items():
            top[g] = max(top[g], x)
    members = {k: {gram_hash(g) for g, n in c.items() if n * lang.ONE_IN >= c.total() and share[k][g] >= lang.LEAST_SHARE * top[g]} for k, c in counts.items()}
    assert model.languages == sorted(members)
    size = 1 << max(10, (max(map(len, members.values())) * lang.ROWS_PER_GRAM - 1).bit_length())

    def places(h):
        out = []
        for _ in range(lang.PROBES):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % (1 << 64)
            out.append((h >> 16) % size)
        return out

    held = {k: {p for h in m for p in places(h)} for k, m in members.items()}
    assert len(model.table) == size
    rates = {k: (len(p) / size) ** lang.PROBES for k, p in held.items()}
    assert [rates[k] for k in model.languages] == pytest.approx(model.rates.tolist())
    texts = [r.text for r in rows if r.text][:40] + ["", "1 2 3", "zzqqxx jjkkww"]
    for text, (name, score) in zip(texts, model.predict(lang.clean(texts)), strict=True):
        found = [set(places(gram_hash(g))) for g in plain_grams(text)]
        n = len(found)
        right = {k: max(0.0, (sum(p <= held[k] for p in found) - n * rates[k]) / max(1e-9, 1 - rates[k])) for k in model.languages}
        best = max(right.values())
        if not any(c.isalpha() for c in text):
            assert (name, score) == (lang.UNKNOWN, 0.0)
        elif best:
            assert name == min(k for k in right if right[k] == best) and score == pytest.approx(best / sum(right.values()))


def test_a_very_long_text_is_identified_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang.fit_languages(docs)
    text = " ".join(r.text for r in docs.where("lang = 'en'").collect() if r.text)
    whole = model.predict([text])[0]
    monkeypatch.setattr(lang, "BLOCK", 5000)
    pieces = model.predict([text, "a"])[0]
    assert pieces[0] == whole[0] and pieces[1] == pytest.approx(whole[1], rel=1e-3)


def test_language_ties_repeats_and_columns(spark):
    rows, k = [], 0
    for name in ("bb", "aa"):  # two names for the same text: the counts are equal
        for _ in range(8):
            rows.append((k, "same words in both same words in both", name, 1.0))
            k += 1
    rows += [(900, "same words in both", None, 2.0)] * 2
    docs = spark.createDataFrame(rows, DOC + ", lang string, score double")
    out = lang.language_report(docs).where("doc_id = 900").collect()
    assert [x.lang_pred for x in out] == ["aa", "aa"] and all(x.score == pytest.approx(0.5) for x in out)


# --- others ---------------------------------------------------------------------------------------


def test_simhash_repeats_and_columns(spark):
    rows = [(5, "a b c d e", 1), (5, "a b c d e", 2), (7, "A b c d E", 3), (None, "a b c d e", 4), (8, "wholly other words stand here", 5)]
    docs = spark.createDataFrame(rows, DOC + ", fp int")
    got = sorted(((x.doc_id, x.component_id) for x in simhash.simhash_components(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (7, 5), (None, 5), (8, 8)], key=str)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [5, 8]
    assert {tuple(x) for x in kept.collect()} == {tuple(x) for x in simhash.drop_near_duplicates(docs.repartition(3)).collect()}


def test_tokens_edges_and_foreign_readers(spark):
    import zstandard

    rows = [(3, "some words", 1), (3, "some words", 2), (None, "x", 3), (1 << 60, "long id", 4), (4, "w " * 400_000, 5)]
    docs = spark.createDataFrame(rows, DOC + ", start int")
    manifest = to.write_tokens(docs, TOKENIZER, files=2)
    got = to.read_tokens(manifest).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r.doc_id for r in to.lookup_tokens(manifest, [3, 1 << 60]).collect()} == {3, 1 << 60}
    bounds = [(r.least, r.most) for r in manifest.where("least is not null").collect()]
    assert min(a for a, _ in bounds) == 3 and max(b for _, b in bounds) == 1 << 60
    # A tool that knows nothing of the table unpacks the ids of all documents.
    for r in manifest.collect():
        reader = to.FileReader(r.path)
        with open(r.path, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as z:
            assert np.array_equal(np.frombuffer(z.read(), f"<u{reader.width}"), np.concatenate(list(reader)))


def test_a_task_that_is_run_again_replaces_its_file(tmp_path):
    path = str(tmp_path / "x.tok")
    for n in (1, 4):
        w = to.FileWriter(path, 2, str(n))
        for i in range(n):
            w.add(i, np.arange(i + 1, dtype="<u2").tobytes())
        w.close()
    assert len(to.FileReader(path)) == 4


def test_landing_keeps_words_and_documents():
    for seed in range(20):
        r = random.Random(seed)
        units = [(k, r.randint(1, 400), r.random()) for k in range(300)]
        f, chosen = mixing.Flight(seed), {}
        for u in units:
            chosen.update(f.add(*u))
        chosen.update(f.land())
        assert len(chosen) == 300
        assert abs(sum(chosen.values()) - sum(p for *_, p in units)) <= 2
        assert abs(sum(s * chosen[k] for k, s, _ in units) - sum(s * p for _, s, p in units)) <= 40


def test_copies_of_rows_that_differ_elsewhere_are_settled(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", i, {"k": i}) for i in range(7)] + [(2, "x " * 50, "t", 0, {"k": 0})], DOC + ", source string, extra int, m map<string,int>")
    some = sorted(r.extra for r in mixing.mix(docs).collect())
    assert all(sorted(r.extra for r in mixing.mix(docs.repartition(k)).collect()) == some for k in (1, 3, 5))


def test_mixing_and_repeats_of_a_very_long_text(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(10**7)}" for _ in range(150_000))
    docs = spark.createDataFrame([(1, long, "a"), (2, long[:300_000], "b"), (3, "few words", "b")], DOC + ", source string")
    assert {x.doc_id: x["size"] for x in mixing.mix_report(docs).collect()}[1] == 150_000
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in repeats_digest(docs).collect()}
    assert got == {1: (len(long), 300_000, 1), 2: (300_000, 300_000, 1), 3: (9, 0, 0)}


def test_fingerprints_of_texts_in_pieces(monkeypatch):
    """A text of several pieces has the fingerprint that it has as a whole."""
    r = random.Random(3)
    text = " ".join(f"w{r.randrange(500)}" for _ in range(400_000))
    assert len(text) > 1 << 20
    pieces = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "lots", lambda t, size=0: iter([t]))
    assert pieces == simhash.fingerprint(text)
