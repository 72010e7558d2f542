"""Matchers against the stated patterns; disguises mapped back to the source."""

import re
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v if v < 10 else v - 9
    return total % 10 == 0


def brute(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-+_ 0125é", max_size=40))
def test_plain_matches(text):
    assert pii.identifiers(text) == brute(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789 -+().", min_size=10, max_size=80))
def test_numbers(text):
    assert pii.identifiers(text) == brute(text)


@pytest.mark.parametrize("text, kind, source", [
    ("write to ann (at) mail [dot] example.com now", "email", "ann (at) mail [dot] example.com"),
    ("write to ann at mail dot example dot com now", "email", "ann at mail dot example dot com"),
    ("ann＠mail．example.com", "email", "ann＠mail．example.com"),
    ("аnn@mail.example.com", "email", None),
    ("call plus four nine five five five one two three four", "phone", None),
    ("dial +1 five five five one two three four five six x", "phone", None),
    ("at １９２.168.0.１ é", "ip", "１９２.168.0.１"),
    ("card ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
    ("😀 bob(at)host(dot)org", "email", "bob(at)host(dot)org"),
])
def test_disguises(text, kind, source):
    base, found = pii.find(text)
    if source is not None:
        assert [text[a:b] for a, b in found[kind]] == [source]
        assert base[kind] == [] or base[kind] != found[kind]
    for a, b in (s for spans in found.values() for s in spans):
        assert 0 <= a < b <= len(text)


@pytest.mark.parametrize("text, kind, plain, source", [
    ("a jоhn.smith@example.com b", "email", ["hn.smith@example.com"], "jоhn.smith@example.com"),
    ("john@example.cоm", "email", ["john@example.c"], "john@example.cоm"),
    ("аnn@mail.example.com", "email", ["nn@mail.example.com"], "аnn@mail.example.com"),
    ("john@mail.example dot com", "email", ["john@mail.example"], "john@mail.example dot com"),
    ("dial +1 555 123 456７ now", "phone", ["+1 555 123 456"], "+1 555 123 456７"),
])
def test_disguises_around_plain_spans(text, kind, plain, source):
    base, found = pii.find(text)
    assert [text[a:b] for a, b in base[kind]] == plain
    assert {text[a:b] for a, b in found[kind]} == {*plain, source}
    assert pii.redacted(text) == text.replace(source, f"<{kind.upper()}>")


def test_disguises_inside_plain_spans():
    text = "john.one.two.three@example.com and 10.0.0.1 (at) x"
    base, found = pii.find(text)
    assert found == base


@pytest.mark.parametrize("text, kind, source", [
    ("write john at example [dot] com now", "email", "john at example [dot] com"),
    ("john at mail.example{dot}com", "email", "john at mail.example{dot}com"),
    ("my IP: 10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
    ("my IP: 10 dot 0 dot zero dot 1", "ip", "10 dot 0 dot zero dot 1"),
    ("host 192.168.zero.one is up", "ip", "192.168.zero.one"),
    ("one.two.three.four", "ip", "one.two.three.four"),
    ("call +1 555 one two 3 4567", "phone", "+1 555 one two 3 4567"),
    ("call plus one 555 123 4567", "phone", "plus one 555 123 4567"),
    ("card 4111 1111 one one 11 111 one", "card", "4111 1111 one one 11 111 one"),
    # a number's end and a word after it: neither reading hides the other
    ("card ４１１１ 1111 1111 1111 two of", "card", "４１１１ 1111 1111 1111"),
])
def test_signs_are_judged_where_they_stand(text, kind, source):
    for around in ("{}", "{} and x dot y", "look at three. {}"):
        whole = around.format(text)
        base, found = pii.find(whole)
        assert base[kind] == [] and [whole[a:b] for a, b in found[kind]] == [source]


@pytest.mark.parametrize("text", [
    "meet at example.com, x dot y", "the only one. 3 of two at 5.one", "in 2020 one of seven", "10 (at) 20, see [1] and {two}", "one.two",
])
def test_clean_texts_stay_with_signs_about(text):
    base, found = pii.find(text)
    assert found == base == brute(text)


def test_many_spelled_digits_take_linear_time():
    for text in ("one " * 100_000, "one.2 " * 60_000, "a at b dot c " * 20_000, "(" * 300_000 + "1 one", "4 one x" * 60_000):
        pii.find(text)


def test_spelled_phone():
    text = "ring plus four nine five five five one two three four today"
    _, found = pii.find(text)
    # a spelled number without separators is one run of digits after the plus
    assert [text[a:b] for a, b in found["phone"]] == ["plus four nine five five five one two three four"]


@pytest.mark.parametrize("text", [
    "look at the. And dot the one two of it", "meet at noon. Two of three are at home", "", "one two", "a@b", "the dot", "(at) [dot]",
])
def test_clean_texts_stay(text):
    base, found = pii.find(text)
    assert found == base == brute(text) and pii.redacted(text) == text


def test_base_spans_stay():
    text = "a@b.example (at) c.d and 10.0.0.1"
    base, found = pii.find(text)
    for kind in pii.KINDS:
        assert set(base[kind]) <= set(found[kind])


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "+1" + "(" * 300_000, "@a." * 100_000, "at " * 200_000):
        pii.find(text)


def test_query_rows(spark):
    rows = [(1, "x a@b.example 10.0.0.1", "k"), (2, None, "k"), (None, "", None), (1, "x a@b.example 10.0.0.1", "k"),
            (3, "+1 (555) 123-4567 " * 2000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find_personal_data(df).collect()
    assert len(got) == 5
    for r in got:
        if r.doc_id == 1:
            assert (r.n_email, r.n_ip, r.spans) == (1, 1, "email:2:13,ip:14:22")
    assert sum(r.n_phone for r in got) == 2000
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_redaction_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.example", 16), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "mail <EMAIL>", 12), (2, None, None)]


class Plain:
    """The tracing of ``pii.Traced`` with two whole numbers for every character."""

    def __init__(self, text):
        self.text, self.spans = text, [(k, k + 1) for k in range(len(text))]

    def rewrite(self, edits):
        out, spans, at = [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            out += [self.text[at:a], new]
            spans += self.spans[at:a] + [(self.spans[a][0], self.spans[b - 1][1]) if new else None] * len(new)
            at = b
        self.text, self.spans = "".join(out), spans


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abcdef", min_size=1, max_size=30), st.lists(st.lists(st.tuples(st.integers(0, 29), st.integers(1, 4), st.sampled_from(["", "x", "yz"])), max_size=6), max_size=3))
def test_tracing_against_a_list_per_character(text, rounds):
    traced, plain = pii.Traced(text), Plain(text)
    for wanted in rounds:
        edits, done = [], 0
        for a, n, new in sorted(wanted):
            if done <= a and a + n <= len(plain.text):
                edits.append((a, a + n, new))
                done = a + n
        traced.rewrite(edits)
        plain.rewrite(edits)
        assert traced.text == plain.text
        for a in range(len(plain.text)):
            for b in range(a + 1, len(plain.text) + 1):
                assert traced.source((a, b)) == (plain.spans[a][0], plain.spans[b - 1][1])


def test_disguises_in_a_very_long_text_take_little_memory():
    filler = "plain words of a long text without anything to find in them. " * 245_000
    text = "а" + filler + "write to ann (at) mail [dot] example.com or call +1 555 one two 3 4567 " + filler
    assert len(text) > 29_000_000
    tracemalloc.start()
    base, found = pii.find(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [text[a:b] for a, b in found["email"]] == ["ann (at) mail [dot] example.com"]
    assert [text[a:b] for a, b in found["phone"]] == ["+1 555 one two 3 4567"] and base["email"] == []
    assert peak < 500e6
