"""The span classifier on texts with known answers, the context labeler's languages, and secrets."""

import random

from tidewater.llm.pii import KINDS, candidates, find, fit, mask, spans, train, undecided

FOR = {
    "local_phone": ["call ({a}) 555-{d}", "teléfono ({a}) 555-{d}", "Telefon {a}-555-{d}", "téléphone {a}.555.{d}"],
    "national_id": ["ssn {a}-12-{d}", "social security {a}-45-{d}"],
    "bank_account": ["konto DE89 3704 0044 0532 0130 00", "cuenta GB82 WEST 1234 5698 7654 32"],
    "spelled_email": ["write to ann.lee (at) site{a} (dot) com", "correo max [at] host{a} [dot] org"],
    "person": ["signed Dr. Maria Stone", "contact Mr James Hill"],
    "secret": ['token = "{h}"', "api key: {m}", 'contraseña "{m}"', "Passwort {m}"],
}
AGAINST = ["see isbn 000-00-{d} there", "order 911-00-0000 of", "commit {h} of the day", "sha {h} sum", "version 1.2.3 is out", "item AB12 CDEF 3456 GHIJ part", "Dr. Nothing said", "a meeting at noon dot matrix"]


def labelled(n=600, seed=3):
    rnd = random.Random(seed)
    for i in range(n):
        values = {"a": rnd.randrange(200, 660), "d": rnd.randrange(1000, 9999), "h": f"{rnd.getrandbits(160):040x}", "m": "x9A" + "".join(rnd.choice("abcXYZ012789") for _ in range(25))}
        kind = rnd.choice(list(FOR)) if i % 2 else None
        yield "la lune est haute, und " + rnd.choice(FOR[kind] if kind else AGAINST).format(**values) + ", dijo ayer", kind


def test_precision_and_recall_on_labelled_texts(spark):
    rows = list(labelled())
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    said = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",") if s} for r in find(df).collect()}
    right = sum(said[i] == {k} for i, (_, k) in enumerate(rows) if k)
    wrong = sum(bool(said[i]) for i, (_, k) in enumerate(rows) if not k)
    assert right >= 0.95 * sum(k is not None for _, k in rows) and wrong <= 0.05 * sum(k is None for _, k in rows), (right, wrong)


def test_the_model_of_one_corpus_holds_for_another(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled(400, 5))], "doc_id long, text string")
    model, rows = fit(df), list(labelled(400, 6))
    assert sum({s.kind for s in spans(t, model)} == ({k} if k else set()) for t, k in rows) >= 0.95 * len(rows)


def test_no_kind_turns_a_labeler_round_for_others():
    model = train({("card", -1, 1, 0, 0): 10**6, ("card", -1, -1, 0, 0): 10**6, ("secret", 1, 0, 1, 2): 10**6})
    assert [s.kind for s in spans("mobile (476) 555-5473", model)] == ["local_phone"]
    assert (model.by_kind[KINDS.index("card"), 0, 0, 0]) > 0.9


def test_numbers_that_fail_their_check_are_not_added(spark):
    rows = [(i, f"ein 4532015112830366 und {4532015112830367 + 10 * i} sowie mail a{i}@b.com") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {s.split(":")[0] for r in find(df).collect() for s in r.spans.split(",")} == {"card", "email"}
    model = fit(df)
    assert not any(not s.base for _, t in rows for s in spans(t, model))


def test_context_votes_in_four_languages():
    for word in ("phone", "teléfono", "Telefon", "téléphone"):
        assert [s.votes[2] for s in candidates(f"{word} (476) 555-5473")] == [1]
    assert [s.votes[2] for s in candidates("rechnung 476-555-5473")] == [-1]


def test_candidates_under_base_spans_are_not_counted():
    every = candidates("+1 (476) 555-5473 and (476) 555-5474")
    assert {s.kind for s in every} == {"phone", "local_phone"}
    assert [(s.start, s.kind) for s in undecided(every)] == [(22, "local_phone")]


def test_secrets(spark):
    model, key = train({}), "f0ddae3b09ae356cbefecdd3232fa5489bb400d6"
    assert [(s.start, s.end) for s in spans(f'den token = "{key}" enen', model)] == [(13, 53)]
    for clean in ("a" * 60, "-" * 60, "1" * 60, "donaudampfschifffahrtsgesellschaft", "under_scored_names_of_code", f"commit {key}"):
        assert spans(clean, model) == []
    df = spark.createDataFrame([(1, f'token = "{key}"'), (1, None), (None, "")], "doc_id long, text string")
    assert [r.text for r in mask(df, model).collect()] == ['token = "<SECRET>"', None, ""]


def test_long_spelled_addresses_are_whole():
    text = "x" * 200 + " (at) host (dot) com"
    assert [(s.start, s.end) for s in candidates(text)] == [(0, len(text))]
