"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction beyond them.

One pass over the texts finds the seeds (emails, IPs, cards, phones), and the candidates: strings that
look like an identifier but match no fixed pattern. Both come with the one and two words before them.
These words are the lexical patterns. Patterns and instances are the two sides of a graph, which Spark
scores in rounds: a pattern's confidence in a kind is the lower bound (Wilson) of the share of its
instances that are of that kind, and an unknown instance takes the best confidence of its patterns,
if its shape allows that kind. Candidates whose pattern is confident in the end become spans.

Patterns that precede kinds at random don't get confident: the bound needs about a dozen distinct
instances that agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import decode, pieces, save, text_of

#: In the order of the report.
KINDS = ("email", "ip", "card", "phone")
#: What may stand before the at-sign of an email, and what follows it.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Matches only begin where a run of digits does, as no other place in it can do better.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
NUMBER = re.compile(r"\+?\(?[0-9][0-9().\x20-]*[0-9]")
AFTER = re.compile(r"\s?[^\s@]{1,255}")
MARK = re.compile(r"@|\(at\)|\[at\]")
TRIM = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost emails that don't overlap, from each at-sign outward, so in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(LOCAL))
        last = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap, less those that fail their test.

    Each kind takes time linear in the text.
    """
    found = [(0, *span) for span in emails(text)]
    if "." in text:
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """What stands around an at-sign of any spelling: up to 64 characters before and 255 after it, one blank apart at most."""
    for m in MARK.finditer(text):
        before = text[max(0, m.start() - 65) : m.start()]
        blank = before[-1:].isspace()
        before = (before[:-1] if blank else before).replace("@", " ")
        left = before.split()[-1][-64:] if before and not before[-1].isspace() else ""
        right = AFTER.match(text, m.end())
        if left and right:
            yield m.start() - blank - len(left), right.end()


def candidate_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Strings with a digit or an at-sign of any spelling that touch no seed, of 5 to 80 characters."""
    found = list(addresses(text))
    last = 0
    for m in DIGITS.finditer(text):
        if m.start() < last:
            continue
        start, end = m.span()
        while start > last and start > m.start() - 64 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and end < m.end() + 64 and not text[end].isspace():
            end += 1
        if wide := NUMBER.match(text, start, min(len(text), start + 64)):
            end = max(end, wide.end())
        last = end
        found.append((start, end))
    busy: list[list[int]] = []  # the seeds, merged where they overlap
    for start, end in sorted((a, b) for _, a, b in taken):
        if busy and start <= busy[-1][1]:
            busy[-1][1] = max(busy[-1][1], end)
        else:
            busy.append([start, end])
    out, i = [], 0
    for start, end in sorted(found):
        if end - start > 200:
            continue  # far too long even without the marks around it
        while start < end and text[start] in TRIM:
            start += 1
        while end > start and text[end - 1] in TRIM:
            end -= 1
        while i < len(busy) and busy[i][1] <= start - 200:
            i += 1
        near = i
        while near < len(busy) and busy[near][1] <= start:
            near += 1
        if 5 <= end - start <= 80 and not (near < len(busy) and busy[near][0] < end) and not (out and start < out[-1][1]):
            out.append((start, end))
    return out


def allowed_kinds(instance: str) -> list[int]:
    """Kinds that a string of this shape may be."""
    digits = sum(c.isdigit() for c in instance)
    letters = sum(c.isalpha() for c in instance)
    kinds = []
    if letters > 2 and ("@" in instance or "(at)" in instance or "[at]" in instance):
        kinds.append(0)
    if letters <= 6 and digits >= 4 and (instance.count(".") >= 3 or instance.count(":") >= 2):
        kinds.append(1)
    if not letters and 12 <= digits <= 19:
        kinds.append(2)
    if not letters and 7 <= digits <= 15 and "." not in instance.strip("."):
        kinds.append(3)
    return kinds


def left_patterns(text: str, start: int) -> list[str]:
    """The word before, and the two words before, in lower case."""
    words = [w.strip(TRIM) for w in text[max(0, start - 80) : start].lower().split()]
    words = [w for w in words if w][-2:]
    return ([f"1 {words[-1]}"] if words else []) + ([f"2 {words[0]} {words[1]}"] if len(words) == 2 else [])


def find(docs: DataFrame, *, rounds: int = 3, confident: float = 0.8, z: float = 1.64, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and found (arrays of kind, start, end) and the columns in ``carry``, as carried_0 and on, of every row.

    Offsets are code points of the whole text, ends exclusive; kinds are places in KINDS. ``base`` are
    the matches of the fixed patterns and ``found`` the spans that contexts add, which touch no base
    span. Null and empty texts have none. Repeated rows come out repeated, an empty table empty.
    """
    names = [f"carried_{i}" for i in range(len(carry))]
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("kind", pa.int32()), ("allowed", pa.list_(pa.int32()))])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            spans, strings = [], []
            for raw in batch.column("text").to_pylist():
                text = decode(raw)
                base = base_spans(text)
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
                own = []
                for kind, a, b in [*base, *((None, *c) for c in candidate_spans(text, base))]:
                    instance = text[a:b]
                    allowed = [kind] if kind is not None else allowed_kinds(instance)
                    if allowed and (patterns := left_patterns(text, a)):
                        own.append({"start": a, "end": b, "instance": instance.lower(), "patterns": patterns, "kind": kind, "allowed": allowed})
                strings.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id")), pa.array(spans, pa.list_(span)), pa.array(strings, pa.list_(seen)), *(batch.column(n) for n in names)], ["row", "doc_id", "base", "strings", *names])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    kinds = dict(rows.dtypes)
    schema = "row long, doc_id long, base array<struct<kind:int,start:int,end:int>>, strings array<struct<start:int,end:int,instance:string,patterns:array<string>,kind:int,allowed:array<int>>>" + "".join(f", {n} {kinds[n]}" for n in names)
    rows = save(rows.mapInArrow(scan, schema), "personal-rows")

    met = rows.select("row", F.explode("strings").alias("s")).select("row", "s.start", "s.end", "s.instance", "s.kind", "s.allowed", F.explode("s.patterns").alias("pattern"))
    # the graph: one edge for a pattern and an instance, however often they meet
    edges = save(met.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.first("allowed").alias("allowed")), "personal-edges")
    share = F.col("sure") / F.col("n")
    lower = (share + z * z / (2 * F.col("n")) - z * F.sqrt(share * (1 - share) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    seeds = edges.where("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    scores, patterns = seeds, None
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    for _ in range(rounds):
        sure = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sure"))
        # few patterns pass: a share of a kind's instances over the bound
        patterns = save(sure.join(size, "pattern").withColumn("sure", F.least("sure", "n")).withColumn("score", lower).where(F.col("score") >= confident).select("pattern", "kind", "score"), "personal-patterns")
        new = edges.where("kind is null").select("pattern", "instance", F.explode("allowed").alias("kind")).join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("score").alias("score"))
        scores = seeds.unionByName(new).groupBy("instance", "kind").agg(F.max("score").alias("score"))

    chosen = met.where("kind is null").select("row", "start", "end", "pattern", F.explode("allowed").alias("kind")).join(patterns, ["pattern", "kind"])
    best = chosen.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    found = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))  # of one text
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.join(found, "row", "left").select("doc_id", "base", F.coalesce("found", none).alias("found"), *names)


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans (base and added), from what ``find`` returns."""
    names = F.array(*(F.lit(k) for k in KINDS))
    written = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "found")).alias("spans"),
    )


def redact(docs: DataFrame, *, mark: str = "[{}]") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind's mark; where spans overlap, by the first one's.

    All rows and columns stay, whatever their names are. A null text stays null and an empty one empty;
    repeated rows come out repeated, an empty table empty. A task holds 4 MB of texts, or one longer text.
    """
    kept = [c for c in docs.columns if c != "doc_id"]
    names, at_text = [f"carried_{i}" for i in range(len(kept))], kept.index("text")

    def run(batches):
        for batch in pieces(batches, names[at_text]):
            out = []
            for text, base, found in zip(*(batch.column(c).to_pylist() for c in (names[at_text], "base", "found")), strict=True):
                spans = sorted(((s["start"], -s["end"], s["kind"]) for s in [*base, *found]))
                parts, at = [], 0
                for start, end, kind in spans:
                    if start >= at:
                        parts += [text[at:start], mark.format(KINDS[kind].upper())]
                        at = -end
                    elif -end > at:
                        at = -end
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out, pa.string()) if i == at_text else batch.column(n) for i, n in enumerate(names))], ["doc_id", *names])

    kinds = dict(docs.dtypes)
    schema = "doc_id long" + "".join(f", {n} {kinds[c]}" for n, c in zip(names, kept, strict=True))
    masked = find(docs, carry=tuple(kept)).mapInArrow(run, schema)
    place = dict(zip(kept, names, strict=True)) | {"doc_id": "doc_id"}
    return masked.select(*(F.col(place[c]).alias(c) for c in docs.columns))
