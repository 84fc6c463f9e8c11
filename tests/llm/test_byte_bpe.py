import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from lodestone.llm.byte_bpe import ByteBpe, digests, encode_documents

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    own = ByteBpe.from_file(PATH, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_equals_the_library_on_odd_strings(both):
    own, library = both
    pick = random.Random(3)
    odd = "  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　abcZé你好🙂'sre''ll  0123.,!?́\u0000İßΣς²"
    texts = ["", " ", "a" * 3000, "<|endoftext|>"] + ["".join(pick.choice(odd) for _ in range(pick.randint(1, 30))) for _ in range(4000)]
    for text in texts:
        ids = own.encode(text)
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_odd_rows_and_empty(spark, odd, odd_rows, empty, both):
    found = digests(encode_documents(odd, PATH, P.PATTERN)).collect()
    want = []
    for r in odd_rows:
        ids = both[1].encode_ordinary(r[1] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)
    assert digests(encode_documents(empty, PATH, P.PATTERN)).count() == 0
