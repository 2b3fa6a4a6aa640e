"""Personal data by weak supervision.

Candidates come from patterns over whole texts: the base kinds (email, ip, card, phone) as their
contract states them, matches of those patterns that fail their checks, and looser kinds (local
phone, national id, bank account, spelled-out email, titled name, secret key or token).  Three
labelers vote on each candidate, for, against or not at all:

    form       its checksum, ranges or layout
    gazetteer  known domains, country codes, area codes, given names, prefixes of keys
    context    words shortly before it, in four languages, that name its kind, or name something else

Vote patterns are counted over all documents, with the candidate's shape (a bounded table); candidates
that a base span covers are left out, as nothing is decided on them, and base spans count as known
personal data.  Expectation-maximisation on those counts estimates each labeler's reliability by kind and each pattern's chance of being personal data.  A logistic span classifier is trained against those
chances on kind, votes and shape, which no labeler sees.  Base spans always stay; the classifier
decides which other candidates are added.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, only, slices, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "national_id", "bank_account", "spelled_email", "person", "secret")
KINDS = BASE + ADDED
LABELERS = ("form", "gazetteer", "context")
#: What a candidate's text looks like, one bit each: letters or digits touch it; it stands after = or :; it has few distinct characters.
SHAPES = ("glued", "assigned", "plain")
#: The classifier adds a span from this chance on, so a tie of two votes adds nothing.
ACCEPT = 0.55
#: Characters before a candidate in which the context labeler looks.
WINDOW = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+)])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BANK = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AT = re.compile(r" ?[(\[]at[)\]] ?| at ")
_DOT = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?[(\[]dot[)\]] ?| dot )[A-Za-z]{2,24}(?![A-Za-z])")
_PERSON = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_ASSIGNED = re.compile(r"[=:] ?[\"']?$")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

_DOMAINS = frozenset("com net org edu gov io de fr es uk us eu info example".split())
_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
_GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth anna maria jose juan carmen pierre marie jean claire hans peter julia thomas laura paul sophie karl emma".split())
_PREFIXES = ("AKIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "sk-", "xoxb-", "xoxp-", "eyJ")
_MAIL = "email e-mail mail contact write reach correo courriel adresse kontakt schreiben escribir"
_CALL = "phone call tel telephone mobile fax dial whatsapp telefon handy anrufen rufnummer teléfono móvil llamar téléphone portable appeler"
_NAMES = {
    "email": _MAIL,
    "spelled_email": _MAIL,
    "ip": "ip address host server client login from adresse rechner servidor serveur",
    "card": "card visa mastercard credit debit payment pay karte kreditkarte tarjeta crédito carte paiement",
    "phone": _CALL,
    "local_phone": _CALL,
    "national_id": "ssn social security id identity tax ausweis steuer identidad identité",
    "bank_account": "iban bank account transfer konto überweisung cuenta transferencia compte virement",
    "person": "name contact by patient signed dear",
    "secret": "token secret key apikey api-key api password passwd pwd auth bearer credential credentials passwort schlüssel contraseña clave passe clé",
}
_CONTEXT = {k: frozenset(v.split()) for k, v in _NAMES.items()}
_AGAINST = frozenset(
    "isbn issn version release page pages chapter section order invoice sku part item serial figure table dimension pi commit sha hash md checksum digest revision "
    "seite kapitel bestellung rechnung página capítulo pedido factura chapitre commande facture".split()
)


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    base: bool
    votes: tuple[int, int, int]
    shape: int = 0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern in linear time: from each @ to both sides."""
    floor, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _context(text: str, start: int, kind: str) -> int:
    words = _WORD.findall(text[max(0, start - WINDOW) : start].lower())[-6:]
    if any(w in _CONTEXT[kind] for w in words):
        return 1
    return -1 if any(w in _AGAINST for w in words) else 0


def _secret(run: str) -> tuple[int, int] | None:
    """Form and gazetteer votes of a long run, None for one that is no candidate: a word, a number, a row of dashes."""
    if sum(map(str.isdigit, run)) < 3 or not any(map(str.isalpha, run)):
        return None
    known = 1 if run.startswith(_PREFIXES) else 0
    if len(run) > 256:
        return -1, known
    mixed = any(map(str.islower, run)) and any(map(str.isupper, run))
    return (1 if mixed else 0), known  # digits and letters of one case may as well be a checksum


def _shape(text: str, a: int, b: int) -> int:
    glued = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    assigned = bool(_ASSIGNED.search(text[max(0, a - 3) : a]))
    few = len({c for c in text[a : min(b, a + 64)] if c.isalnum()}) < 4
    return glued + 2 * assigned + 4 * few


def candidates(text: str) -> list[Span]:
    """All base matches and other candidates of a text, base ones marked; others may overlap them."""
    found: list[tuple[int, int, str, bool, int, int]] = []
    if "@" in text:
        for a, b in _emails(text):
            found.append((a, b, "email", True, 1, 1 if text[a:b].rsplit(".", 1)[1].lower() in _DOMAINS else 0))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            good = all(map(_small, m[0].split(".")))
            found.append((m.start(), m.end(), "ip", good, 1 if good else -1, -1 if m[0].startswith("0") else 0))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 13:
                continue
            digits = re.sub("[^0-9]", "", m[0])
            if len(digits) >= 13:
                good = 14 <= len(digits) <= 19 and luhn(digits)
                found.append((m.start(), m.end(), "card", good, 1 if good else -1, 1 if digits[0] in "3456" else -1))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = sum(c.isdigit() for c in m[0])
                found.append((m.start(), m.end(), "phone", 10 <= n <= 15, 1 if 10 <= n <= 15 else -1, 0))
        for m in _LOCAL_PHONE.finditer(text):
            found.append((m.start(), m.end(), "local_phone", False, 1, -1 if re.sub("[^0-9]", "", m[0])[0] in "01" else 1))
        for m in _NATIONAL.finditer(text):
            area, group, serial = m[0].split("-")
            found.append((m.start(), m.end(), "national_id", False, 1 if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else -1, 0))
        for m in _BANK.finditer(text):
            found.append((m.start(), m.end(), "bank_account", False, 1 if _iban(m[0]) else -1, 1 if m[0][:2] in _COUNTRIES else -1))
        for m in _SECRET.finditer(text):
            votes = _secret(m[0])
            if votes:
                found.append((m.start(), m.end(), "secret", False, *votes))
    for m in _AT.finditer(text):
        right = _DOT.match(text, m.end())
        if right:
            a = m.start()
            while a > 0 and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                bracketed = "(" in m[0] or "[" in m[0]
                found.append((a, right.end(), "spelled_email", False, 1 if bracketed else 0, 1 if right[0].split()[-1].lower() in _DOMAINS else -1))
    for m in _PERSON.finditer(text):
        names = m[0].split()[1:]
        found.append((m.start(), m.end(), "person", False, 0, 1 if names[0].lower() in _GIVEN else -1))
    return [Span(a, b, kind, base, (form, gaz, _context(text, a, kind)), _shape(text, a, b)) for a, b, kind, base, form, gaz in sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))]


def undecided(every: list[Span]) -> list[Span]:
    """The candidates, sorted by start, that are no base spans and overlap none."""
    edges = [(s.start, s.end) for s in every if s.base]
    out, at, reach = [], 0, 0
    for s in every:
        while at < len(edges) and edges[at][0] < s.end:
            reach = max(reach, edges[at][1])
            at += 1
        if not s.base and reach <= s.start:
            out.append(s)
    return out


class Model(NamedTuple):
    """P(vote | personal or not) by labeler, class and vote, over all kinds and by kind; weights of the span classifier."""

    prior: float
    reliability: np.ndarray
    weights: np.ndarray
    by_kind: np.ndarray

    def accepts(self, span: Span) -> bool:
        return float(features(span.kind, span.votes, span.shape) @ self.weights) > np.log(ACCEPT / (1 - ACCEPT))


def features(kind: str, votes: tuple[int, ...], shape: int = 0) -> np.ndarray:
    """Bias, kind, each labeler's vote for or against, and the shape's bits."""
    at = 1 + len(KINDS) + 2 * len(LABELERS)
    x = np.zeros(at + len(SHAPES))
    x[0] = x[1 + KINDS.index(kind)] = 1
    for i, v in enumerate(votes):
        x[1 + len(KINDS) + 2 * i] = v == 1
        x[2 + len(KINDS) + 2 * i] = v == -1
    for i in range(len(SHAPES)):
        x[at + i] = shape >> i & 1
    return x


def train(counts: dict[tuple, int], rounds: int = 50) -> Model:
    """EM over counts of (kind, votes..., and shape and known, if given), then the classifier.  Pseudo-counts say that
    labelers are right more often than not, so no or little data gives a sensible model too, and no
    kind's many rows turn a labeler round for the others."""
    keys = sorted(counts)
    labelers = range(len(LABELERS))
    kinds = np.array([KINDS.index(k[0]) for k in keys], int)
    votes = np.array([k[1:4] for k in keys], int).reshape(-1, len(LABELERS)) + 1
    shapes = [k[4] if len(k) > 4 else 0 for k in keys]
    known = np.array([len(k) > 5 and k[5] for k in keys], float)
    n = np.array([counts[k] for k in keys], float)
    start = np.zeros((len(LABELERS), 2, 3))
    start[:, 0] = (0.5, 0.4, 0.1)
    start[:, 1] = (0.1, 0.4, 0.5)
    prior, table = 0.5, start.copy()
    chance, tables = np.full(len(KINDS), 0.5), np.repeat(start[None], len(KINDS), axis=0)

    def personal(kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
        like = np.stack([np.prod([tables[kind, i, c, vote[:, i]] for i in labelers], axis=0) for c in (0, 1)])
        both = like * np.stack([1 - chance[kind], chance[kind]])
        return both[1] / both.sum(axis=0)

    for _ in range(rounds):
        post = np.maximum(known, personal(kinds, votes))
        open_ = n * (1 - known)  # known ones tell how labelers vote, not how many of the others are personal
        prior = float((open_ @ post + 5) / (open_.sum() + 10))
        total, good = np.bincount(kinds, open_, len(KINDS)), np.bincount(kinds, open_ * post, len(KINDS))
        chance = (good + 5) / (total + 10)
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for i in labelers:
                seen = np.bincount(kinds * 3 + votes[:, i], w, len(KINDS) * 3).reshape(-1, 3)
                table[i, c] = (seen.sum(axis=0) + 20 * start[i, c]) / (seen.sum() + 20)
                tables[:, i, c] = (seen + 20 * start[i, c]) / (seen.sum(axis=1, keepdims=True) + 20)
    post = np.maximum(known, personal(kinds, votes))
    # Every vote pattern of every kind counts as one more row, labelled by the labelers alone.
    every = [(k, (a, b, c)) for k in range(len(KINDS)) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    chance = np.full(len(KINDS), 0.5)
    alone = personal(np.array([k for k, _ in every]), np.array([v for _, v in every]) + 1)
    x = np.array([features(k[0], k[1:4], shape) for k, shape in zip(keys, shapes)] + [features(KINDS[k], v) for k, v in every])
    y = np.concatenate([post, alone])
    w = np.concatenate([np.log1p(n), np.ones(len(every))])
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (w * (y - p)) - 0.1 * beta)
    return Model(prior, table, beta, tables)


#: Columns of the table of vote patterns.
PATTERN = ("kind", *LABELERS, "shape", "known")


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    counts: Counter = Counter()
    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                if text:
                    every = candidates(text)
                    counts.update((s.kind, *s.votes, s.shape, 0) for s in undecided(every))
                    counts.update((s.kind, *s.votes, s.shape, 1) for s in every if s.base)
    rows = [(*k, n) for k, n in counts.items()]
    cols = list(zip(*rows)) if rows else [[]] * 7
    yield pa.record_batch([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], [*PATTERN, "n"])


def fit(docs: DataFrame) -> Model:
    """Trains on the candidates of all documents; the driver sees counts of vote patterns only."""
    bounded_batches(docs.sparkSession)
    votes = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_votes, "kind string, form long, gazetteer long, context long, shape long, known long, n long")
    rows = votes.groupBy(*PATTERN).agg(F.sum("n").alias("n")).collect()  # at most kinds * 27 * 8 * 2
    return train({tuple(r)[:6]: r.n for r in rows})


def spans(text: str | None, model: Model) -> list[Span]:
    """Base spans and the accepted others that overlap nothing kept before them."""
    if not text:
        return []
    every = candidates(text)
    kept = [s for s in every if s.base]
    more: list[Span] = []
    for s in undecided(every):
        if (not more or more[-1].end <= s.start) and model.accepts(s):
            more.append(s)
    return sorted(kept + more, key=lambda s: (s.start, KINDS.index(s.kind)))


def listed(some: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in some)


def _find(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in slices(batch, "text"):
                n: list[list[int]] = [[], [], [], []]
                sha, every = [], []
                for text in part.column("text").to_pylist():
                    got = spans(text, model)
                    base = [s for s in got if s.base]
                    for i, kind in enumerate(BASE):
                        n[i].append(sum(s.kind == kind for s in base))
                    sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                    every.append(listed(got))
                yield pa.record_batch(
                    [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(sha), pa.array(every)],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return run


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_email, n_ip, n_card,
    n_phone, base_sha256, spans.  A null or empty text has none; null or repeated doc_ids are kept as they are."""
    docs = texts(docs)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.mapInArrow(_find(model or fit(docs)), schema)


def masked(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping base spans become one."""
    out, at = [], 0
    for s in spans(text, model):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:] if out else text


def _mask(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t and masked(t, model) for t in part.column("text").to_pylist()]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, "text", pa.array(texts, pa.string()))

    return run


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` masked; all other columns and rows stay."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_mask(model or fit(docs)), docs.schema)
