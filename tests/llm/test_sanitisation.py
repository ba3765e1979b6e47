import hashlib
import re

from claimspan.llm import sanitisation as s

SPEC = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(reversed(digits)):
            n = int(d) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    """(counts, hash) of the base spans."""
    spans = [(m.start(), k, m.end()) for k, p in enumerate(SPEC.values())
             for m in p.finditer(text or "") if valid(list(SPEC)[k], m.group())]
    names = list(SPEC)
    line = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return ([sum(k == i for _, k, _ in spans) for i in range(4)],
            hashlib.sha256(line.encode()).hexdigest(), line)


def got(df):
    return {r.doc_id: ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256,
                       ",".join(x for x in r.spans.split(",") if not x.startswith("term")))
            for r in s.report(df).collect()}


def test_equals_patterns_on_the_whole_table(documents):
    expected = {r.doc_id: brute(r.text) for r in documents.collect()}
    assert got(documents) == expected
    assert sum(sum(c) for c, _, _ in expected.values()) > 5


ODD = [(1, None), (2, ""), (3, "a@b.c_d@e.f.@x.y @z.q"), (4, "😀é 1.2.3.4.5.6.7.8 1.2.3"),
       (5, "256.1.1.1 255.000255.0.1 99999999999999999999.1.1.1"),
       (6, "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 0"),
       (7, "+1 (743) 555-3824 +44 20 7946 0958 +1 2 +123456789012345678"),
       (8, "+1 " + " " * 60_000 + "2"), (9, "1 " * 60_000), (10, "x" * 120_000 + "@"),
       (11, "a.b@" * 20_000 + "c.d"), (12, "+4111 1111 1111 1111"), (None, "q@w.er"),
       (13, "me@a-b.co.uk.\n+49(0)30-123456"), (13, "me@a-b.co.uk.\n+49(0)30-123456"),
       (14, "1.1.1.1 " * 3_000)]


def test_odd_rows(make):
    df = make(ODD)
    expected = {d: brute(t) for d, t in ODD}
    assert got(df) == expected
    assert s.report(df).count() == len(ODD)
    assert s.report(make([])).collect() == []


def test_terms_that_disclose(make):
    rows = [(i, f"Professor Zyxwv answers at zed@uni.example in room {i}") for i in range(4)]
    rows += [(i, f"Professor Other writes of room {i}") for i in range(10, 400)]
    out = {r.doc_id: r for r in s.report(make(rows)).collect()}
    text = rows[0][1]
    parts = [p.split(":") for p in out[0].spans.split(",")]
    found = {(k, text[int(a):int(b)]) for k, a, b in parts}
    assert found == {("email", "zed@uni.example"), ("term", "Zyxwv"), ("term", "answers")}
    assert out[0].n_email == 1 and out[10].spans == ""
    clean = {r.doc_id: r.text for r in s.redact(make(rows)).collect()}
    assert clean[0] == "Professor [TERM] [TERM] at [EMAIL] in room 0"
    assert clean[10] == rows[4][1]


def test_redact_odd_rows(make):
    df = make(ODD)
    out = s.redact(df)
    assert out.columns == df.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] is None and text[2] == "" and text[12] == "+[CARD]"
    assert text[13] == "[EMAIL].\n[PHONE]"


def test_terms_of_an_entity_in_one_document(make):
    rows = [(1, "Professor Zyxwv answers at zed@uni.example in room one"),
            (2, "Call Qwert on +49 30 1234567 now"), (3, "Qwert writes of room two")]
    rows += [(i, f"Professor Other answers calls of room {i}") for i in range(10, 400)]
    out = {r.doc_id: r.spans for r in s.report(make(rows)).collect()}

    def terms(doc, text):
        parts = [p.split(":") for p in out[doc].split(",")]
        return {text[int(a):int(b)] for k, a, b in parts if k == "term"}
    assert terms(1, rows[0][1]) == {"Zyxwv", "one"}
    assert terms(2, rows[1][1]) == {"Call", "Qwert", "now"} and out[3] == ""
    clean = {r.doc_id: r.text for r in s.redact(make(rows)).collect()}
    assert clean[1] == "Professor [...] answers at [EMAIL] in room [...]"
