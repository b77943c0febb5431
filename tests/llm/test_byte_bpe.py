import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from rowsieve.llm.byte_bpe import TreeEncoder, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tree():
    return TreeEncoder(PATH, leaf_chars=7, leaf_bytes=5)


def test_random_texts(tree):
    rng = random.Random(1)
    alphabets = ["ab 'sret", "aé1 \n\t.,", "  \n\n a'll", "日本語 、x1", "0123 .", "\x1c   a!", "🙂é a"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 90)))
        ids = tree.encode(text)
        assert ids == tree.core.encode_ordinary(text), text
        assert tree.decode(ids) == text.encode()


def test_long_runs():
    tree = TreeEncoder(PATH, leaf_chars=300, leaf_bytes=16)
    rng = random.Random(2)
    for alphabet in ("a", "ab", "abcdefghijklmnop", "0", "0123456789", "!", "!?.-'", " ", " \n", "日本", "thingeréa"):
        text = "x " + "".join(rng.choice(alphabet) for _ in range(9000)) + " tail's end"
        assert tree.encode(text) == tree.core.encode_ordinary(text), alphabet


def test_default_leaves_and_documents():
    tree, rng = TreeEncoder(PATH), random.Random(3)
    words = ["the", "l'été", "don't", "we'll", "12", "3.5", "---", "\n\n", "  ", "ß"]
    text = " ".join(rng.choice(words) for _ in range(20000))
    assert tree.encode(text) == tree.core.encode_ordinary(text)
    assert tree.decode(tree.encode(text)) == text.encode()
    assert tree.encode("") == [] and tree.decode([]) == b""


def test_texts_of_usual_length_go_up_the_tree():
    tree, rng, joins = TreeEncoder(PATH), random.Random(4), []
    join = tree._join
    tree._join = lambda text, lo, mid, hi, *halves: joins.append((lo, hi)) or join(text, lo, mid, hi, *halves)
    for n in (100, 256, 257, 1000, 3000):
        text = "".join(rng.choice("aeinrst  .'\né1") for _ in range(n))
        joins.clear()
        assert tree.encode(text) == tree.core.encode_ordinary(text)
        assert bool(joins) == (n > 256) and (not joins or joins[-1] == (0, n)) and len(joins) >= n // 257


def test_documents(spark):
    tree = TreeEncoder(PATH)
    rows = [(1, "It's a test", 5), (None, "no key", None), (2, None, 1), (3, "", 1), (4, "long text " * 30_000, 1), (1, "It's a test", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint").repartition(3)
    got = encode_documents(docs).collect()
    want = []
    for k, text, _ in rows:
        ids = tree.core.encode_ordinary(text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, dtype="<u4").tobytes(), (text or "").encode())]
        want.append(str((k, len(ids), *digests, ids)))
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids)) for r in got) == sorted(want)
    assert "ids" not in encode_documents(docs, ids=False).columns
    assert encode_documents(docs.limit(0)).count() == 0
