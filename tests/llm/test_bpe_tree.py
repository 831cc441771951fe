import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus as C  # noqa: E402

bpe_tree = pytest.importorskip("orderscope.llm.bpe_tree")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe_tree.Codec(open(PATH, encoding="utf-8").read())


def digests(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    out = []
    for d, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def odd_texts(seed, n):
    r = random.Random(seed)
    parts = ["<|endoftext|>", "<|endof", "text|>", "the", "  ", "'re", "'", "re", " don't", "\n\n", " naïve", "aaaaaaaa", "!!!!!!!", " ", "\t", "\u00a0", " \u2003", "\u3000 ", "\x1c", " \x85", "漢字", "😀", "́"]
    letters = ["ab", "abcdefgh", "a ", "a ", " \n\t", " a'srelv", "é漢😀a ", "0123 ", "!?'s ", "xyz'll 've  "]
    for _ in range(n):
        m = r.randint(1, 1500)
        a = r.choice(letters)
        t = "".join(r.choice(parts) for _ in range(m // 3 + 1)) if r.random() < 0.4 else "".join(r.choice(a) for _ in range(m))
        yield t + " " * r.randint(1, 900) + t if r.random() < 0.2 else t


def test_joined_halves_are_the_whole_texts_ids(codec):
    for k, text in enumerate(odd_texts(7, 400)):
        pieces = bpe_tree.halves(text, (3, 40, 250)[k % 3])
        assert "".join(pieces) == text
        data, ids = [p.encode() for p in pieces], codec.encode(pieces)
        while len(ids) > 1:
            both = [a + b for a, b in zip(data[::2], data[1::2])]
            ids = [codec.join(d, len(a), x, y) for d, a, x, y in zip(both, data[::2], ids[::2], ids[1::2])]
            data = both
        assert ids[0].tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids[0]).decode() == text == codec.tokenizer.decode(ids[0].tolist(), skip_special_tokens=False)


def test_windows_grow_until_both_sides_agree(codec):
    """One word of 60,000 letters has no edge for a window to stop at but agreeing tokens."""
    r = random.Random(1)
    for letters in ("a", "ab", "aeiouns"):
        text = "".join(r.choice(letters) for _ in range(60_000))
        left, right = codec.encode([text[:30_000], text[30_000:]])
        assert np.array_equal(codec.join(text.encode(), 30_000, left, right), codec.encode([text])[0])


ROWS = C.documents(n=20) + [(500 + i, t, None, None) for i, t in enumerate(odd_texts(3, 12))] + [(600, "unsplit" * 9000, None, None)]


@pytest.mark.parametrize("rows", [ROWS, []], ids=["awkward", "empty"])
def test_encoded_and_decoded(spark, rows):
    """Nulls, empty texts, special tokens, long texts, repeated rows, null keys and clashing names."""
    docs = (C.frame(spark, rows).withColumnRenamed("doc_id", "key").withColumnRenamed("text", "body")
            .withColumns({"row": F.lit(1), "piece": F.lit(2), "ids": F.lit("x"), "text": F.lit("y")}))
    ids = bpe_tree.encoded(docs, PATH, key="key", text="body", long=400, leaf=130)
    got = bpe_tree.decoded(ids, PATH, key="key").select(
        "key", F.size("ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256), F.sha2("text", 256)).collect()
    C.same(got, digests(rows))
    both = bpe_tree.encoded(docs, PATH, key="key", text="body", long=400, leaf=130, decode=True).select(
        "key", F.size("ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256), F.sha2("text", 256)).collect()
    C.same(both, digests(rows))


def test_query(spark, tmp_path):
    C.frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe_tree.op13_bpe_tree(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    C.same(got.collect(), digests(ROWS))
