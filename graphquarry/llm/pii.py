"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Every text yields candidates of four kinds: matches of the base patterns, and looser spellings (spelled-out
e-mail addresses and IP addresses, phone numbers without a plus sign, card numbers with other
separators, base matches that fail their check). Labelers vote for, against or not at all on each.
Vote patterns are counted over all documents; expectation-maximisation on those counts estimates each
labeler's reliability per kind without any labels; a logistic regression on votes and shape, fitted to
the resulting probabilities, is the span classifier. Base matches that pass their check always stay;
of the others, those the classifier accepts are added unless their validity labeler votes against them or
they overlap a span already taken.

Defined cases: null and empty texts have no spans; without candidates there is no model and nothing is
added; ties between overlapping additions go to the likelier, then the earlier span. Positions are
code points, the end is exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from graphquarry.llm.common import bounded_batches, kept, table, without

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
EM_ROUNDS = 60
CONTEXT_CHARS = 48
LABELERS = ("regex", "validity", "gazetteer", "context", "boundary")
CANDIDATE = pa.struct([
    ("kind", pa.int8()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()),
    ("votes", pa.list_(pa.int8())), ("shape", pa.list_(pa.int8())),
])
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A dotted quad never starts inside a run of digits; saying so keeps long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_SPELLED_AT = re.compile(
    r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)"
    r"([A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63})+)", re.I
)
_SPELLED_DOT = re.compile(r"\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20", re.I)
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20?\[dot\]\x20?|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])", re.I)
_LOOSE_PHONE = re.compile(r"(?<![0-9+.])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][\x20().0-9-]{7,20}[0-9]")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[./_]|\x20\x20)[0-9]{4}(?:[./_]|\x20\x20)[0-9]{4}(?:[./_]|\x20\x20)[0-9]{4}(?![0-9])")

# Gazetteers: fixed values.
TOP_DOMAINS = frozenset((
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "ai", "app", "dev", "eu", "de", "at", "ch",
    "fr", "be", "nl", "es", "pt", "it", "uk", "ie", "us", "ca", "mx", "br", "ar", "se", "no", "dk", "fi", "pl", "cz", "ru",
    "ua", "tr", "in", "cn", "jp", "kr", "au", "nz", "za",
))
CARD_PREFIXES = ("34", "35", "36", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "22", "23", "24", "25", "26", "27")
COUNTRY_CODES = ("1", "20", "27", "3", "40", "41", "43", "44", "45", "46", "47", "48", "49", "5", "6", "7", "81", "82", "86", "90", "91")
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write", "reach", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login", "ping"),
    "card": ("card", "visa", "master", "amex", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "sms", "number", "anruf"),
}
AGAINST_WORDS = ("version", "build", "isbn", "order", "invoice", "serial", "section", "ref", "sku", "release")


@dataclass(frozen=True)
class Match:
    kind: int
    start: int
    stop: int
    value: str
    base: bool
    strict: bool


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) - 9 * (d > "4") if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def valid(kind: int, value: str) -> bool:
    """The check behind each base pattern."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    digits = _NOT_DIGIT.sub("", value)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15
    return True


def base_matches(text: str) -> list[Match]:
    """Matches of the base patterns, leftmost and not overlapping within a kind; ``base`` if the check holds."""
    found, end = [], 0
    if "@" in text:
        # An address is found from its @: what precedes it reaches back to the last address at most.
        for m in _AT_DOMAIN.finditer(text):
            start = _local_start(text, m.start(), end)
            if start < m.start():
                found.append(Match(0, start, m.end(), text[start : m.end()], True, True))
                end = m.end()
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            value = m.group()
            if kind == 2 and len(value) < 13:
                continue
            ok = valid(kind, value)
            found.append(Match(kind, m.start(), m.end(), value, ok, True))
    return found


def loose_matches(text: str) -> list[Match]:
    """Spellings the base patterns miss, with the value they stand for."""
    found = []
    for m in _SPELLED_AT.finditer(text):
        start = _local_start(text, m.start(), 0)
        if start < m.start():
            domain = _SPELLED_DOT.sub(".", m.group(1))
            found.append(Match(0, start, m.end(), f"{text[start:m.start()]}@{domain}", False, "[" in m.group() or "(" in m.group() or "{" in m.group()))
    for kind, pattern in ((1, _LOOSE_IP), (2, _LOOSE_CARD), (3, _LOOSE_PHONE)):
        for m in pattern.finditer(text):
            value = m.group()
            if kind == 1:
                value = re.sub(r"[^0-9]+", ".", value)
            elif kind == 3:
                value = "+" + value[2:] if value.startswith("00") else "+1" + value
            found.append(Match(kind, m.start(), m.end(), value, False, "(" in m.group() or "-" in m.group()))
    return found


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def votes(text: str, m: Match) -> list[int]:
    """One vote per labeler: 1 for, -1 against, 0 none."""
    kind, digits = KINDS[m.kind], _NOT_DIGIT.sub("", m.value)
    before = text[max(0, m.start - CONTEXT_CHARS) : m.start].lower()
    around = text[m.start - 1 : m.start] if m.start else "", text[m.stop : m.stop + 1]
    if kind == "email":
        gazetteer = _vote(m.value.rpartition(".")[2].lower() in TOP_DOMAINS, True)
    elif kind == "ip":
        gazetteer = _vote(False, digits.startswith("0") or digits.endswith("0000"))
    elif kind == "card":
        gazetteer = _vote(digits.startswith(CARD_PREFIXES), True)
    else:
        gazetteer = _vote(digits.startswith(COUNTRY_CODES), True)
    said = set(re.findall(r"[a-z]+", before))
    known = any(w.startswith(CONTEXT_WORDS[kind]) for w in said)
    return [
        _vote(m.strict, not m.strict), _vote(valid(m.kind, m.value), True), gazetteer,
        _vote(known, not known and not said.isdisjoint(AGAINST_WORDS)),
        _vote(not any(c.isalnum() or c in "@_/" for c in around if c), True),
    ]


def shape(m: Match) -> list[int]:
    """Bounded features of the span itself: base or not, length class, digit class, separators."""
    digits = sum(c.isdigit() for c in m.value)
    marks = sum(not c.isalnum() for c in m.value)
    return [int(m.base), min((m.stop - m.start) // 8, 4), min(digits // 4, 5), min(marks, 4)]


class Taken:
    """Ranges in use, merged where they overlap, in order."""

    def __init__(self, ranges: Iterable[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []
        for start, stop in sorted(ranges):
            if self.stops and start < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop)
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def free(self, start: int, stop: int) -> bool:
        at = bisect_left(self.starts, stop)
        return at == 0 or self.stops[at - 1] <= start

    def add(self, start: int, stop: int) -> None:
        """Take a free range."""
        insort(self.starts, start)
        insort(self.stops, stop)


def candidates(text: str | None) -> list[dict]:
    if not text:
        return []
    found = base_matches(text)
    taken = Taken((m.start, m.stop) for m in found if m.base)
    extra = [m for m in loose_matches(text) if taken.free(m.start, m.stop)]
    return [
        {"kind": m.kind, "start": m.start, "stop": m.stop, "base": m.base, "votes": votes(text, m), "shape": shape(m)}
        for m in found + extra
    ]


@arrow_udf(from_arrow_type(pa.list_(CANDIDATE)))
def candidate_spans(texts: pa.Array) -> pa.Array:
    return pa.array([candidates(t.as_py()) for t in texts], pa.list_(CANDIDATE))


def _reliabilities(votes_: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: P(true | votes), and P(vote | class) for each labeler."""
    shown = np.stack([votes_ == v for v in (-1, 0, 1)], axis=2).astype(float)
    believed = 1 / (1 + np.exp(-votes_.sum(1, dtype=float)))
    for _ in range(EM_ROUNDS):
        by_class = np.stack([1 - believed, believed], axis=1) * weight[:, None]
        # pseudo-counts say that labelers are better than chance, which also fixes which class is which
        prior = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])[:, None, :]
        rates = np.einsum("pc,plv->clv", by_class, shown) + prior
        rates /= rates.sum(2, keepdims=True)
        share = (by_class.sum(0) + 1) / (by_class.sum() + 2)
        logs = np.einsum("plv,clv->pc", shown, np.log(rates)) + np.log(share)
        believed = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return believed, rates


def _features(votes_: np.ndarray, shapes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    parts = [np.ones((len(votes_), 1))]
    parts += [votes_ == v for v in (-1, 0, 1)]
    parts += [shapes == v for v in range(6)]
    parts += [(kinds == k)[:, None] * np.concatenate([np.ones((len(votes_), 1)), votes_], 1) for k in range(len(KINDS))]
    return np.concatenate(parts, 1).astype(float)


def _fit(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels by gradient steps with a fixed curvature bound."""
    weight = weight / weight.sum()
    w, seen = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    step = 4 / (np.einsum("pf,pf,p->", x, x, weight) + decay)
    for i in range(rounds):
        ahead = w + (i / (i + 3)) * (w - seen)
        seen = w
        w = ahead - step * (x.T @ (weight * (1 / (1 + np.exp(-x @ ahead)) - target)) + decay * ahead)
    return w


def train(found: DataFrame) -> dict:
    """Reliabilities and classifier weights from the vote patterns of all candidates.

    Votes and shapes take few values, so the pattern table has a fixed bound and only it reaches the driver.
    """
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.shape")
    rows = each.groupBy("kind", "votes", "shape").count().orderBy("kind", "votes", "shape").collect()
    if not rows:
        return {"weights": None, "reliability": {}}
    kinds = np.array([r["kind"] for r in rows])
    seen = np.array([list(r["votes"]) for r in rows])
    shapes = np.array([list(r["shape"]) for r in rows])
    weight = np.array([r["count"] for r in rows], float)
    believed, reliability = np.zeros(len(rows)), {}
    for k in np.unique(kinds):
        own = kinds == k
        believed[own], rates = _reliabilities(seen[own], weight[own])
        reliability[KINDS[k]] = {n: {"true": rates[1, i].tolist(), "false": rates[0, i].tolist()} for i, n in enumerate(LABELERS)}
    # log counts keep rare spellings from drowning in common ones
    return {"weights": _fit(_features(seen, shapes, kinds), believed, np.log1p(weight)), "reliability": reliability}


def decide(found: list[dict], weights: np.ndarray | None, accept: float = ACCEPT) -> list[dict]:
    """Base spans, and accepted others that overlap nothing taken, by start and kind."""
    chosen = [c for c in found if c["base"]]
    others = [c for c in found if not c["base"] and c["votes"][1] > 0]
    if others and weights is not None:
        x = _features(np.array([c["votes"] for c in others]), np.array([c["shape"] for c in others]), np.array([c["kind"] for c in others]))
        taken = Taken((c["start"], c["stop"]) for c in chosen)
        likely = 1 / (1 + np.exp(-x @ weights))
        for p, c in sorted(zip(likely, others, strict=True), key=lambda t: (-t[0], t[1]["start"], t[1]["kind"])):
            if p >= accept and taken.free(c["start"], c["stop"]):
                chosen.append(c)
                taken.add(c["start"], c["stop"])
    return sorted(
        ({"kind": KINDS[c["kind"]], "start": c["start"], "stop": c["stop"]} for c in chosen),
        key=lambda s: (s["start"], KINDS.index(s["kind"])),
    )


def decider(weights: np.ndarray | None, accept: float):
    @arrow_udf(from_arrow_type(pa.list_(SPAN)))
    def spans(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lists:
            yield pa.array([decide(c.as_py() or [], weights, accept) for c in batch], pa.list_(SPAN))

    return spans


def find(docs: DataFrame, text: str = "text", accept: float = ACCEPT, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``base_spans`` and ``spans``, arrays of (kind, start, stop), to every document.

    Texts are read once; their few candidates are kept as a table, from which the model is trained and
    the decisions made. ``carry`` names the input columns to return, all by default.
    """
    bounded_batches(docs)
    docs = without(docs, "candidates", "base_spans", "spans")
    columns = list(docs.columns if carry is None else carry)
    found = kept(docs.select(*columns, candidate_spans(F.col(text)).alias("candidates")), "pii-candidates")
    model = train(found)
    bases = F.transform(
        F.array_sort(F.transform(F.filter("candidates", lambda c: c["base"]), lambda c: F.struct(c["start"], c["kind"], c["stop"]))),
        lambda c: F.struct(
            F.element_at(F.array(*map(F.lit, KINDS)), c["kind"].cast("int") + 1).alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")
        ),
    )
    return found.select(*columns, bases.alias("base_spans"), decider(model["weights"], accept)(F.col("candidates")).alias("spans"))


def masked_text(text: str | None, spans: list[dict]) -> str | None:
    """``text`` with each span replaced by its kind in brackets; overlapping base spans become one."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for s in spans:
        if s["stop"] > at:
            parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"] if s["start"] >= at else []
            at = s["stop"]
    return "".join(parts) + text[at:]


def masker(weights: np.ndarray | None, accept: float):
    @arrow_udf(from_arrow_type(pa.string()))
    def masked(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = zip(texts, lists, strict=True)
        return pa.array([masked_text(t.as_py(), decide(c.as_py() or [], weights, accept)) for t, c in rows], pa.string())

    return masked


def mask(docs: DataFrame, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with every span replaced by its kind. Decision and masking share one Python step."""
    bounded_batches(docs)
    # the input row rides along whole, so that none of its columns can clash with the operator's
    slim = docs.select(F.struct(*docs.columns).alias("row_"), candidate_spans(F.col(text)).alias("candidates"))
    found = kept(slim, "pii-candidates", "zstd")
    model = train(found)
    whole = masker(model["weights"], accept)(F.col("row_")[text], F.col("candidates")).alias(text)
    return found.select(*[whole if c == text else F.col("row_")[c].alias(c) for c in docs.columns])


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), carry=("doc_id",))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
