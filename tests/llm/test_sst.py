import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rowsieve.llm import sst

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_encode_as_whole_texts():
    whole, mine, rng = Tokenizer.from_file(PATH), sst.WordEncoder(PATH), random.Random(1)
    chars = [*"ab Éé'sS1 \n\t\r.,!<≠é×÷ßµ\xa0\x85\x1c ć日本İﬁΣς|>", "<|endoftext|>", "<|startoftext|>", "<|endof", "Word "]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(chars) for _ in range(20_000)), "word one, two. " * 7_000]
    assert whole.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    for text in [*texts, "<|endoftext|>", "a <|startoftext|> b", "<|ENDOFTEXT|>", " ", "\n"]:
        assert mine.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(sst, "CACHED_WORDS", 10)
    mine = sst.WordEncoder(PATH)
    plain = Tokenizer.from_file(PATH)
    for i in range(50):
        text = " ".join(f"w{j}" for j in range(i, i + 5))
        assert mine.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(mine.words) <= 25


def test_file_round_trip_and_lookup(tmp_path):
    rng = random.Random(2)
    rows = sorted(((k, [rng.randrange(49408) for _ in range(rng.randint(0, 9))]) for k in [None, *rng.sample(range(-900, 900), 700), 5, 5]), key=lambda r: sst.pack_key(r[0]))
    rows[3] = (rows[3][0], [70_000])
    writer = sst.Writer(f"{tmp_path}/a.sst")
    for k, ids in rows:
        writer.add(sst.pack_key(k), np.array(ids, dtype="<u4"))
    writer.close()
    reader = sst.Reader(f"file://{tmp_path}/a.sst")
    assert [(sst.unpack_key(k), ids.tolist()) for k, ids in reader] == rows
    assert (reader.entries, reader.ids) == (len(rows), sum(len(x) for _, x in rows))
    for k in {k for k, _ in rows}:
        assert sorted(x.tolist() for x in reader.get(sst.pack_key(k))) == sorted(x for j, x in rows if j == k)
    absent = [k for k in range(-3000, 3000) if k not in {x for x, _ in rows}]
    assert all(not reader.get(sst.pack_key(k)) for k in absent)
    assert sum(sst.pack_key(k) in reader.bloom for k in absent) < 0.05 * len(absent)


def test_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sst, "SHARD_IDS", 40)
    texts = {7: "Hello there", 3: None, 11: "", 2: "x " * 500, 5: "It's\n12 o'clock"}
    rows = [(k, t, "extra") for k, t in texts.items()] + [(i, f"word {i}", "e") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, path string").repartition(3)
    manifest = sst.write_shards(docs, f"file://{tmp_path}/shards", PATH).cache()
    assert manifest.count() > 2
    plain, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in sst.read_documents(manifest).collect()}
    assert len(got) == len(rows)
    for k, text, _ in sorted(rows):
        ids = [*(plain.encode(text, add_special_tokens=False).ids if text else []), 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert sst.read_documents(sst.write_shards(docs.limit(0), f"file://{tmp_path}/none", PATH)).count() == 0


def test_a_key_of_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sst, "SHARD_IDS", 50)
    rows = [(7, f"word {i}") for i in range(300)] + [(i, "one two") for i in range(5)] + [(i, "x") for i in range(8, 12)] + [(None, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    manifest = sst.write_shards(docs, f"file://{tmp_path}/hot", PATH).cache()
    assert sum(sst.unpack_key(bytes(r.first_key)) == 7 for r in manifest.collect()) > 3
    got = sorted(sst.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[0].start == 0
