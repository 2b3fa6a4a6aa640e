import hashlib
import random
import re

from tidewater.llm.pii import BASE, candidates, find, fit, listed, luhn, mask, spans, train


def brute(text):
    """Base spans straight from the stated patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_base_spans():
    rnd = random.Random(1)
    bits = ["a@b.c", "@", "x.y%z@d-e.fr.", "1.2.3.4", "255.255.255.256", "1.2.3.4.5.6.7.8.9", "4444 3333 2222 1111", "5555-5555-5555-4444", "4111111111111111", "+1 (476) 555-5473", "+12", "+1 2", "_", "é", " ", " ", "\n", "-", ".", "7", "00", "@b.c_d@e.f", "+", "(at)", "0001.1.1.01"]
    for _ in range(20000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        assert listed([s for s in candidates(text) if s.base]) == brute(text), repr(text)


def test_long_texts_take_linear_time():
    for unit in ("a", "1", "1.", "@", "a@", "+1", "1 ", "+1(", "A1", "at "):
        spans(unit * (400_000 // len(unit)), train({}))


def test_added_spans(spark):
    texts = [
        "Please call my phone (476) 555-5473 tonight",
        "his ssn is 219-09-9999 and",
        "iban DE89 3704 0044 0532 0130 00 for transfer",
        "write to jane.doe (at) example (dot) com soon",
        "see isbn 000-00-0000 or order 111-222-3333x",
        "clean prose at the end of a day, version 1.2.3",
        None,
        "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    got = {r.doc_id: r for r in find(df).collect()}
    assert got[0].spans == "local_phone:21:35" and got[1].spans == "national_id:11:22"
    assert got[2].spans == "bank_account:5:32" and got[3].spans == "spelled_email:9:40"
    assert got[4].spans == got[5].spans == got[6].spans == got[7].spans == ""
    assert got[7].base_sha256 == hashlib.sha256(b"").hexdigest()
    texts = {r.doc_id: r.text for r in mask(df).collect()}
    assert texts[0] == "Please call my phone <LOCAL_PHONE> tonight" and texts[6] is None and texts[5] == df.where("doc_id = 5").first().text


def test_reliabilities_follow_the_votes():
    m = train({("email", 1, 1, 0): 900, ("email", 1, 1, 1): 100, ("card", -1, -1, 0): 500, ("card", -1, 1, 0): 30})
    assert m.reliability[0, 1, 2] > 0.9 and m.reliability[0, 0, 0] > 0.9
    assert BASE == ("email", "ip", "card", "phone")


def test_edges(spark):
    schema = "doc_id long, text string, spans string, form long"
    assert find(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a@b.c", "x", 1), (1, "a@b.c", None, None), (1, "a@b.c", "", 0)], schema)
    assert [r.spans for r in find(df).collect()] == ["email:0:5"] * 3
    assert [tuple(r) for r in mask(df, fit(df)).collect()] == [(None, "<EMAIL>", "x", 1), (1, "<EMAIL>", None, None), (1, "<EMAIL>", "", 0)]
