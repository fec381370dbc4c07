import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from hornlog.llm import bpe

from . import brute


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def model():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.BytePairModel(f.read())


def same(library, model, texts):
    ids = [np.frombuffer(x, "<u4").tolist() for x in model.encode_batch(texts)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids == want
    assert [model.decode(np.array(x, "<u4").tobytes()) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_odd_texts(library, model):
    same(library, model, ["", " ", "a<|endoftext|>b  <|endoftext|><|endoftext|> ", "don't  I'll\n\n x ", "a" * 999, "日本語 😀😀", "\x85a\u200b　c\x1c", "ǅ٣½", "\n \t\r\n x"])


def test_random_texts(library, model):
    rng = random.Random(4)
    letters = "abcdefghet oanisr'THE 0123\n\t.,é-_"
    same(library, model, ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)])


def test_every_code_point_of_the_first_planes(library, model):
    same(library, model, [f"a{chr(c)}1{chr(c)} {chr(c)}  b" for c in range(0x20000) if not 0xD800 <= c < 0xE000 and c % 3 == 0])


def test_digest_and_round_trip(spark, documents, library):
    rows = documents.select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        import hashlib

        want.append((r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.digest(documents).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(documents)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
    assert bpe.digest(documents.limit(0)).count() == 0
