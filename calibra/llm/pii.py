"""PII by weak supervision: labelers vote, expectation-maximisation weighs them, a trained classifier decides.

Exact base spans (emails, IP addresses, card and phone numbers) are always kept. Beyond them a wider net proposes
candidate spans. Regex, gazetteer and context labelers vote on each candidate: for, against, or abstain. Over the
corpus, candidates with equal kind, votes and length class are counted; there are at most a few thousand such
patterns, whatever the number of documents, so the counts of all documents go to the driver and nothing else.
Expectation-maximisation on the counts estimates each labeler's reliability and each pattern's chance of being
personal data; a logistic regression on kind, votes and length is trained on these soft labels and decides.

Spans are in code points, end exclusive. All scans are linear in the text.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, stored

#: Base kinds in their order, then the kinds that the method adds.
BASE = ["email", "ip", "card", "phone"]
ADDED = ["ssn", "iban", "name", "secret"]
KINDS = BASE + ADDED

# --- base spans ------------------------------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match begins at the start of a run of digits: else the run's earlier digit would have begun it
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards, so that a long run of letters is read once."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        run = text[done:at]
        start = done + len(run.rstrip(_LOCAL))
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            nxt = m.end()
        done = nxt
        at = text.find("@", nxt)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- candidates and labelers -----------------------------------------------------------------------------------------

#: Given names of the gazetteer and the words that speak for or against personal data on the left.
NAMES = set("""James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph
Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Steven Margaret Paul Sandra Andrew Ashley
Emily George Maria Anna Peter Alice Hans Pierre Jean Juan Carlos Marie Sophie Lucas Heinrich Ingrid Pablo Lucia""".split())
FOR = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "reach me"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "pay"),
    "email": ("mail", "contact", "write"),
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "bank"),
    "name": ("my name is", "name:", "mr", "mrs", "ms", "dr", "contact", "signed", "dear", "regards"),
    "secret": ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "bearer"),
}
AGAINST = ("isbn", "version", "invoice", "order", "serial", "part no", "page", "total", "sha", "commit", "checksum")
_NETS = [  # none of them inside a longer run of letters and digits
    ("phone", re.compile(r"(?<![A-Za-z0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])")),
    ("card", re.compile(r"[0-9](?<![A-Za-z0-9][0-9])(?:[ -]?[0-9])++(?![A-Za-z])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("name", re.compile(r"[A-Z][a-z]++ [A-Z][a-z]++")),
    ("secret", re.compile(r"[A-Za-z0-9_-]{20,}+")),
]
_DIGIT = re.compile("[0-9]")
LEFT = 30  # code points of context on the left
LABELERS = ["shape", "gazetteer", "left context", "surroundings", "value"]


def _votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, -1 against, 0 abstains."""
    span, digits = text[a:b], _NOT_DIGIT.sub("", text[a:b])
    left = text[max(0, a - LEFT):a].lower()
    before, after = text[a - 1:a], text[b:b + 1]
    words = span.split()
    if kind == "phone":
        shape = 1 if span[0] == "(" or len({c for c in span if c in " .-"}) == 1 else 0
        value = -1 if len(set(digits)) < 4 or digits[0] in "01" else 1
    elif kind == "ssn":
        shape = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
        value = -1 if len(set(digits)) < 3 else 0
    elif kind == "card":
        groups = re.split("[ -]", span)
        shape = 1 if len(groups) == 4 and {len(g) for g in groups} == {4} else 0
        value = 1 if luhn(digits) else -1
    elif kind == "iban":
        shape = 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1
        value = 1 if int("".join(str(int(c, 36)) for c in (span[4:] + span[:4]).replace(" ", ""))) % 97 == 1 else -1
    elif kind == "name":
        shape = 1 if all(len(w) > 2 for w in words) else -1
        value = 0
    else:
        shape = 1 if len(digits) >= 6 and any(c.isalpha() for c in span) and len(span) >= 32 else -1
        value = 1 if len(set(span)) >= 12 else -1
    known = any(w in NAMES for w in words) if kind == "name" else any(w in span for w in NAMES)
    gazetteer = (1 if known else -1) if kind == "name" else (-1 if known else 0)
    context = 1 if any(re.search(rf"(?<![a-z]){re.escape(w)}", left) for w in FOR[kind]) else (
        -1 if any(w in left for w in AGAINST) else 0)
    glued = (before.isalnum() or after.isalnum()) and (before + after).strip() != ""
    around = -1 if glued else 1 if before in "\"'(<:=" and before or after in "\"')>" and after else 0
    return shape, gazetteer, context, around, value


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, pattern) of spans of the wide net that touch no base span. A pattern is the kind, the votes
    (0 against, 1 abstains, 2 for) and the length class in one string."""
    out = []
    digits = bool(_DIGIT.search(text))
    taken = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in taken]
    tops = list(accumulate((b for _, b in taken), max))  # the furthest end of the spans so far
    for kind, net in _NETS:
        if kind != "name" and not digits:
            continue
        for m in net.finditer(text):
            a, b = m.span()
            if kind == "card" and not 12 <= len(_NOT_DIGIT.sub("", m[0])) <= 19:
                continue
            if kind == "secret" and not _DIGIT.search(m[0]):
                continue
            if _touches(starts, tops, a, b):
                continue
            votes = _votes(kind, text, a, b)
            size = min(3, (b - a) // 12)
            out.append((a, b, KINDS.index(kind), kind + ":" + "".join(str(v + 1) for v in votes) + str(size)))
    return out


def _touches(starts: list[int], tops: list[int], a: int, b: int) -> bool:
    from bisect import bisect_left

    i = bisect_left(starts, b)
    return i > 0 and tops[i - 1] > a


# --- estimation ------------------------------------------------------------------------------------------------------


def _design(patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = np.array([KINDS.index(p.split(":")[0]) for p in patterns])
    votes = np.array([[int(c) for c in p.split(":")[1][:-1]] for p in patterns])
    return kinds, votes, np.array([int(p[-1]) for p in patterns])


def estimate(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """Expectation-maximisation over pattern counts: chance that a pattern is personal data, and each labeler's
    vote shares (labeler x class x vote). Starts from the majority of votes; a weak prior, that a labeler is right
    rather than wrong, fixes which class is which."""
    patterns = sorted(counts)
    kinds, votes, _ = _design(patterns)
    n = np.array([counts[p] for p in patterns], float)
    m = votes.shape[1]
    q = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    prior = np.array([[[4, 3, 1], [1, 3, 4]]] * m, float) * 2  # classes: other, personal
    share = prior
    for _ in range(rounds):
        share = prior.copy()
        rate = np.full(len(KINDS), 0.5)
        for k in set(kinds.tolist()):
            here = kinds == k
            rate[k] = ((n * q)[here].sum() + 1) / (n[here].sum() + 2)
        for j in range(m):
            for v in range(3):
                here = votes[:, j] == v
                share[j, 0, v] += (n * (1 - q))[here].sum()
                share[j, 1, v] += (n * q)[here].sum()
        share /= share.sum(axis=2, keepdims=True)
        odds = np.log(rate[kinds] / (1 - rate[kinds]))
        for j in range(m):
            odds = odds + np.log(share[j, 1, votes[:, j]] / share[j, 0, votes[:, j]])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - q).max() < 1e-9:
            q = new
            break
        q = new
    return dict(zip(patterns, q.tolist())), share


def train(counts: dict[str, int], soft: dict[str, float], ridge: float = 1.0, rounds: int = 30) -> dict[str, float]:
    """Logistic regression (Newton steps, ridge) of the soft labels on kind, votes and length class; pattern -> chance."""
    patterns = sorted(counts)
    kinds, votes, size = _design(patterns)
    x = np.concatenate([np.eye(len(KINDS))[kinds], *(np.eye(3)[votes[:, j]][:, [0, 2]] for j in range(votes.shape[1])),
                        np.eye(4)[size]], axis=1)
    n = np.array([counts[p] for p in patterns], float)
    y = np.array([soft[p] for p in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


#: A candidate becomes a span at this chance.
ACCEPT = 0.9
_SPANS = "array<struct<start: long, end: long, kind: string>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind, by start and then kind), one row per input row.

    A null text counts as empty. Added spans touch no base span and not each other. The texts are read once: base
    spans and candidates are stored (a few bytes a document), patterns are counted, then candidates are judged.
    """

    def read(ids, texts):
        for d, t in zip(ids, texts):
            base = base_spans(t or "")
            yield d, [(a, b, KINDS[k]) for a, b, k in base], [(a, b, f"{KINDS[k]} {p}") for a, b, k, p in
                                                             candidates(t or "", base)]

    found = stored(by_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                           ["doc_id", "text"], read, f"doc_id long, base {_SPANS}, net {_SPANS}"))
    rows = (found.select(F.explode("net").alias("c"))
            .groupBy(F.element_at(F.split("c.kind", " "), 2).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).collect())
    counts = {r["pattern"]: r["n"] for r in rows}  # bounded by kinds x votes x length classes
    chance = train(counts, estimate(counts)[0]) if counts else {}
    good = {p for p, c in chance.items() if c >= accept}

    def judge(ids, bases, nets):
        for d, base, net in zip(ids, bases, nets):
            added: list[tuple] = []
            for c in sorted(net, key=lambda c: (-chance[c["kind"].split(" ")[1]], c["start"], c["end"])):
                kind, pattern = c["kind"].split(" ")
                if pattern in good and all(c["end"] <= a or b <= c["start"] for a, b, _ in added):
                    added.append((c["start"], c["end"], kind))
            own = [(s["start"], s["end"], s["kind"]) for s in base]
            yield d, own, sorted(own + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))

    return by_text(found, ["doc_id", "base", "net"], judge, f"doc_id long, base {_SPANS}, spans {_SPANS}")
