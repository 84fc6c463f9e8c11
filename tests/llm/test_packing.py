import random
import zlib
from collections import defaultdict

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm.packing import WordBpe, first_fit_decreasing, pack_documents

PATH = P.path("word_bpe_49k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_chunks_equal_the_library():
    own, whole, pick = WordBpe(PATH), library(), random.Random(5)
    odd = "  \n\t\r\x0b\x0c\x1c\x85\xa0　abcZé你好🙂'sre''ll  0123.,!?́\u0000İßΣς²<|>"
    texts = ["", "É'S don't ÀB.,! ß; İ. ÞØ!?", "<|endoftext|> a", "x<|startoftext|>Y.<|endoftext|><|ENDOFTEXT|>", *("".join(pick.choice(odd) for _ in range(pick.randint(1, 40))) for _ in range(3000))]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert list(memoryview(ids).cast("I")) == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_memo_stays_within_its_bytes():
    own, whole, pick = WordBpe(PATH, limit=20_000), library(), random.Random(6)
    for _ in range(30):
        text = " ".join("".join(pick.choice("abcdé1.") for _ in range(pick.randint(1, 9))) for _ in range(60))
        assert list(memoryview(own.encode([text])[0]).cast("I")) == whole.encode(text, add_special_tokens=False).ids
        assert own.held < 20_000 + 120 * 300


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_equals_the_plain_search(lengths):
    bins, offsets = first_fit_decreasing(lengths, 50)
    used: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        b = next((k for k, u in enumerate(used) if u + lengths[i] <= 50), len(used))
        if b == len(used):
            used.append(0)
        assert (bins[i], offsets[i]) == (b, used[b])
        used[b] += lengths[i]


def test_odd_rows_and_empty(odd, odd_rows, empty):
    found, whole = pack_documents(odd, PATH).collect(), library()
    assert pack_documents(empty, PATH).count() == 0
    want = defaultdict(int)
    for r in odd_rows:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[(r[0], at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids))] += 1
    got, by = defaultdict(int), defaultdict(list)
    for r in found:
        got[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        by[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
