import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.personal_data import base_spans, candidate_spans, find, luhn, redact, report

#: The patterns as they are given.
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: [c for c in s if c.isdigit()]
    good = (
        lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and luhn("".join(digits(s))), lambda s: 9 <= len(digits(s)) <= 15,
    )
    return [(k, *m.span()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if good[k](m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab19.0@+- ()_%é", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert base_spans(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.d", "@", ".", "1.2.3.4", "10.", "0.0", "4111 1111 1111 1111", "-", " ", "+49 (30) 1234-567", "+", "x_%", "255", "256"]), max_size=25))
def test_base_spans_of_pieces_equal_the_plain_patterns(parts):
    text = "".join(parts)
    assert base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    n = 400_000
    for text in ("7" * n + ".", "a" * n + " x@y.z", "1." * n, "@" * n, "a@" * n, "(at)" * n, "a1" * n, "+1 " * n, "+1" + " " * n, "a.b@c.d " * (n // 8), "4111 1111 1111 1111 a1b2c3 " * (n // 27), "-7" * n):
        began = time.time()
        base = base_spans(text)
        candidate_spans(text, base)
        assert time.time() - began < 15, text[:20]


def card(p):
    head = f"4{p.randrange(10**14):014d}"
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


MAKE = {
    "card": card,
    "ip": lambda p: ".".join(str(p.randrange(256)) for _ in range(4)),
    "email": lambda p: f"u{p.randrange(10**6)}@mail{p.randrange(9)}.example.com",
    "phone": lambda p: f"+1 ({p.randrange(200, 999)}) 555-{p.randrange(10**4):04d}",
}


def test_base_spans_by_the_contract():
    text = "é a.b@c.d-e.org, 300.1.1.1 10.0.0.255, 4111 1111-1111 1111, 4111111111111112, 4111 1111 1111 1111 7 +49 (30) 1234-567 +1 23"
    got = [(k, text[a:b]) for k, a, b in base_spans(text)]
    assert got == [(0, "a.b@c.d-e.org"), (1, "10.0.0.255"), (2, "4111 1111-1111 1111"), (3, "+49 (30) 1234-567")]
    assert base_spans("1.2.3.4.5.6.7.8")[0] == (1, 0, 7) and base_spans("") == []


def test_contexts_find_unseen_identifiers(spark):
    pick = random.Random(8)
    word = lambda: "".join(pick.choice("abdeilnorst") for _ in range(pick.randint(2, 7)))
    rows = []
    for i in range(400):
        kind = pick.choice(list(MAKE))
        cue = {"email": "write to", "phone": "call me", "ip": "host is", "card": "card number"}[kind] if i % 2 else f"{word()} {word()}"
        rows.append((i, " ".join([*(word() for _ in range(8)), cue, MAKE[kind](pick), *(word() for _ in range(5))])))
    rows += [(900, f"{word()} call me 269-555-3296 {word()}"), (901, f"{word()} write to bob(at)example.org {word()}"), (902, f"{word()} version 269-555-3297 {word()}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in find(docs).collect()}
    text = dict(rows)
    added = {d: [text[d][s.start : s.end] for s in r.found] for d, r in got.items() if r.found}
    assert added == {900: ["269-555-3296"], 901: ["bob(at)example.org"]}
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert "[PHONE]" in clean[900] and "555" not in clean[900] and "269-555-3297" in clean[902]
    assert all(not base_spans(t) for t in clean.values())


def test_clashing_names(spark):
    rows = [(1, "call 10.0.0.1 now", "b", 5, None), (None, None, "c", 6, [1]), (2, "", None, 7, []), (2, "", None, 7, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, row int, found array<int>")
    got = sorted((tuple(r) for r in redact(docs.select("base", "text", "doc_id", "found", "row")).collect()), key=repr)
    assert got == sorted(((r[2], "call [IP] now" if r[1] and "10." in r[1] else r[1], r[0], r[4], r[3]) for r in rows), key=repr)


def test_report_odd_rows_and_empty(odd, odd_rows, empty):
    found = report(find(odd)).collect()
    assert len(found) == len(odd_rows) and report(find(empty)).count() == 0
    r = next(r for r in found if r.doc_id == 9)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() and r.spans.startswith("email:5:29,ip:33:41,phone:")
    assert {r.base_sha256 for r in found if r.doc_id in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert redact(odd).columns == odd.columns and redact(odd).count() == len(odd_rows) and redact(empty).count() == 0
