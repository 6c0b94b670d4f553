import random
import re

import pytest

from flowloom.llm import privacy as P
from tests.llm.helpers import awkward, documents, empty

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = (
                kind == 0
                or kind == 1 and all(int(p) <= 255 for p in m.group().split("."))
                or kind == 2 and 12 <= len(digits) <= 19 and P.luhn(digits)
                or kind == 3 and 9 <= len(digits) <= 15
            )
            if fine:
                found.append(P.Span(m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_are_the_patterns():
    rng = random.Random(5)
    for _ in range(6000):
        text = "".join(rng.choice("ab@@..+- 0123456789()_%é") for _ in range(rng.randint(0, 60)))
        assert P.base_spans(text) == brute(text), text
    assert P.base_spans("4539 1488 0343 6467") == [P.Span(0, 2, 19)]


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("mail john dot doe at example dot com now", 0, "john dot doe at example dot com"),
        ("to john [at] example [dot] com.", 0, "john [at] example [dot] com"),
        ("jоhn@exаmple.com", 0, "jоhn@exаmple.com"),
        ("j​ohn@ex​ample.com!", 0, "j​ohn@ex​ample.com"),
        ("from 192[.]168[.]1[.]20 on", 1, "192[.]168[.]1[.]20"),
        ("ring +1 five five five, one two three four five six seven", 3, "+1 five five five, one two three four five six seven"),
        ("pay four five three nine one four eight eight zero three four three six four six seven", 2,
         "four five three nine one four eight eight zero three four three six four six seven"),
        ("pay ４５３９ １４８８ ０３４３ ６４６７", 2, "４５３９ １４８８ ０３４３ ６４６７"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, shown):
    spans = P.hidden_spans(text, P.base_spans(text))
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [(kind, shown)]


@pytest.mark.parametrize(
    "text",
    ["look at the dot com era", "meet at example.com", "two or three at a time", "un deux", "1 2 3", "at of the, on two one"],
)
def test_prose_is_left_alone(text):
    assert P.hidden_spans(text, P.base_spans(text)) == []


def test_frame(spark):
    texts = ["a@b.co and 10.0.0.1 or a at b dot co", "+1 (555) 010-9999 and 4539148803436467"]
    rows = P.find_private(awkward(spark, texts)).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].spans == "" and by_id[2].n_email == 0
    first, second = by_id[100], by_id[101]
    assert (first.n_email, first.n_ip, first.n_hidden) == (1, 1, 1)
    assert first.spans == "email:0:6,ip:11:19,email:23:36"
    assert first.masked == "<email> and <ip> or <email>"
    assert (second.n_phone, second.n_card) == (1, 1)
    plain = P.find_private(documents(spark, texts), hidden=False, masked=False).collect()
    assert [r.base_sha256 for r in plain] == [first.base_sha256, second.base_sha256]
    assert P.find_private(empty(spark)).collect() == []


def test_a_spelled_at_before_a_written_domain():
    for text in ("write to jane.doe at example.com, please", "jane_doe at example.com", "jane7 AT mail.example.org."):
        found = P.hidden_spans(text, P.base_spans(text))
        assert [P.KINDS[s.kind] for s in found] == ["email"] and " at " in text[found[0].start : found[0].end].lower()
    for text in ("meet at x.com", "in 2023 at example.com", "jane.doe at 3.5", "see fig.2 at the example.com site"):
        assert P.hidden_spans(text, P.base_spans(text)) == []


def test_a_very_long_number_in_a_chain():
    long = "0" * 5000
    assert P.base_spans(f"{long}.1.2.3") == [P.Span(0, 1, 5006)]
    assert P.base_spans(f"{long}9999.1.2.3") == []
