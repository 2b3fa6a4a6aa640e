import random
import re

from tidewater.llm.queries import RULES
from tidewater.llm.url_filter import Rule, train, url_filter


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules(spark):
    rnd = random.Random(2)
    urls = ["", None, "x", "://", "http://", "HTTP://A.B.EXAMPLE.ORG/en/12?x", "http://example.org", "http://example.org?/es/", "http://notexample.org/es/1", "a://b://c/d", "http://com/fr/1#x", "http://É.com/de/\nz", "http://example.org/es/#"]
    for _ in range(400):
        urls.append(f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'www.', 'M.', 'x'])}{rnd.choice(['example.org', 'a.com', 'com', 'org', 'b.net', 'Example.NET'])}{rnd.choice(['', '/'])}{rnd.choice(['en', 'es', 'fr', 'de'])}/{rnd.randrange(30)}{rnd.choice(['', '?a=/es/', '#t'])}")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter(df, RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u, RULES)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_held_out_accuracy():
    rnd = random.Random(0)
    rows = []
    for _ in range(1500):
        bad = rnd.random() < 0.4
        host = "".join(rnd.choice("abcdefgh") for _ in range(8)) + rnd.choice([".net", ".com"])
        rows.append((f"{host}\x00/{rnd.choice(['casino', 'pills', 'win-cash'] if bad else ['news', 'science', 'cooking'])}/{rnd.randrange(9999)}", int(bad)))
    model = train([t for t, _ in rows[:1000]], [y for _, y in rows[:1000]])
    import pyarrow as pa

    z = model.score(pa.array([t for t, _ in rows[1000:]]))
    assert sum((s > 0) == y for s, (_, y) in zip(z, rows[1000:])) >= 0.97 * 500


def test_edges(spark):
    schema = "page_id long, url string, host string, ruled string"
    assert url_filter(spark.createDataFrame([], schema), RULES).count() == 0
    df = spark.createDataFrame([(None, None, "x", None), (1, "http://a.org/", None, "y"), (1, "http://a.org/", None, "y")], schema)
    assert sorted((str(r.page_id), r.rule) for r in url_filter(df, RULES).collect() if r.rule) == [("1", "org/"), ("1", "org/")]
    assert url_filter(df, []).count() == 3
    labelled = spark.createDataFrame([("http://a.org/x", "block"), ("http://b.org/y", "allow")], "url string, ruled string")
    assert url_filter(df, [Rule("org", "/", "allow")], labelled=labelled).count() == 3
