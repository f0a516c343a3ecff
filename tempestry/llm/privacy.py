"""Personal data: base patterns, high-recall candidates, and a boosted selection among them.

Base spans (email, ip, card, phone by their stated patterns and checks) are always redacted.  Further
generators propose overlapping candidates that the patterns miss: spelled-out addresses, national and
international phone numbers without a plus sign, cards with other separators, IPv6.  Boosted trees score
each candidate from its format and its context; a threshold per kind is calibrated to a precision on held-out
rows; overlapping candidates are resolved from the best score down.

The model is fitted on a bounded sample: `context_docs` documents, of each at most `context_chars` characters, give the
surroundings, and `sample_rows` candidates of known kind are written into them: personal ones (of those, as far as
there are any, every second one in the place of a base span of its kind) and look-alikes (versions, dates, prices,
measures, identifiers, scope operators, everyday "at" and "dot").  Numbers of the sample itself that look like cards
and fail their check digit are look-alikes too.  Every fourth document and what is written into it is held out; on it
the thresholds are calibrated and `held_out` of the model reports precision and recall of each kind.  Those rows have
the forms that the fit saw; `left_out` tells how a model decides on a form that it has not seen.

Defined results: a null or empty text has no spans; offsets are code points with exclusive ends; repeated
rows are handled one by one; an empty table gives an empty result; further columns, whatever their names, pass
through, and a column named `spans` is replaced.  All scans are linear in the length of a text; spans are sorted.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm import boosting
from tempestry.llm.common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# The base patterns, with a lookbehind where a later start in the same digits can't match either.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_ANY = re.compile(r"[0-9@]|\b[dD][oO][tT]\b|[\[({<]\s?[aA][tT]\s?[\])}>]|:[0-9a-fA-F]{0,4}:")
_SPELLED = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}\s?(?:[\[({<]\s?[aA][tT]\s?[\])}>]|@)\s?[A-Za-z0-9-]{1,63}"
    r"(?:\s?(?:[\[({<]\s?[dD][oO][tT]\s?[\])}>]|\.|\s[dD][oO][tT]\s)\s?[A-Za-z]{2,24}){1,4}(?![\w@])"
)
_SPOKEN = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}\s[aA][tT]\s[A-Za-z0-9-]{1,63}(?:\s[dD][oO][tT]\s[A-Za-z]{2,24}){1,4}(?![\w@])")
_NUMBER = re.compile(r"(?<![\w.,/#-])(?:\(?[0-9]{1,5}\)?(?:[\x20./-]\s?|(?<=\)))){0,6}[0-9]{2,16}(?![\w#])")
_LONG_CARD = re.compile(r"(?<![\w.-])[0-9]{4}(?:[./_][0-9]{3,6}){2,4}(?![\w.-])")
_IP6 = re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])")
_IP6_SHORT = re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?(?![\w:])")
# Common endings of addresses.
_ENDINGS = frozenset("com org net edu gov info biz io co eu uk de fr es it nl ch at be pl us".split())
_HINTS = {
    "phone": re.compile(r"tel|phone|call|fax|mobil|whats|sms|ruf|appel|llam|numero|contact", re.I),
    "mail": re.compile(r"mail|contact|write|address|reach|schreib|correo|courriel", re.I),
    "card": re.compile(r"card|visa|master|credit|pay|karte|carte|tarjeta", re.I),
    "other": re.compile(r"version|\bv\.?$|isbn|issn|order|item|page|price|total|no\.|[$€£=%]|chapter|section|date|year", re.I),
}


@dataclass(frozen=True)
class PrivacyParams:
    context_docs: int = 200
    context_chars: int = 4000
    sample_rows: int = 4000
    precision: float = 0.995
    seed: int = 17


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in time linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind, then start."""
    out = [("email", a, b) for a, b in base_emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the high-recall generators."""
    out = [("email", *m.span()) for pattern in (_SPELLED, _SPOKEN) for m in pattern.finditer(text)]
    for m in _NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m.group())
        if 7 <= n <= 15:
            out.append(("phone", *m.span()))
        if 13 <= n <= 19:
            out.append(("card", *m.span()))
    out += [("card", *m.span()) for m in _LONG_CARD.finditer(text)]
    out += [("ip", *m.span()) for pattern in (_IP6, _IP6_SHORT) for m in pattern.finditer(text) if m.end() - m.start() > 2]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate; no identity of document, source or language."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    return [
        KINDS.index(kind),
        len(s),
        len(digits),
        len(groups),
        max(groups),
        groups[-1],
        groups[0],
        s.count("("),
        s.count(" "),
        s.count("-"),
        s.count("."),
        s.count("/"),
        s.startswith("00"),
        s.startswith("0"),
        13 <= len(digits) <= 19 and luhn(digits),
        groups in ([4, 4, 4, 4], [4, 6, 5]),
        any(x in s for x in "[({<") and "at" in s.lower(),
        re.split(r"\W+", s.lower().rstrip())[-1] in _ENDINGS,
        "::" in s,
        sum(c.isalpha() for c in s),
        "@" in s,
        len(re.findall(r"\bdot\b", s, re.I)),
        s.count(":"),
        bool(_HINTS["phone"].search(before)),
        bool(_HINTS["mail"].search(before)),
        bool(_HINTS["card"].search(before)),
        bool(_HINTS["other"].search(before)),
        before[-1:].isalnum() or before[-1:] in ("$", "€", "#", "="),
        after[:1] in ("%", "€", "$"),
        sum(c.isdigit() for c in before + after),
        any(1900 <= int(g) < 2100 for g in re.findall(r"(?<![0-9])[0-9]{4}(?![0-9])", s)),
        sum(any(c.isdigit() for c in g) and any(c.isalpha() for c in g) for g in s.split(":")) if ":" in s else 0,
    ]


def _planted(rng: random.Random) -> tuple[str, str, str, str, int]:
    """(family, kind, lead, candidate, is personal)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    a = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    x = lambda n: ":".join(f"{rng.randrange(65536):x}" for _ in range(n))
    sep, ending = rng.choice(" -."), rng.choice(sorted(_ENDINGS))
    at, dot = rng.choice(["at", "at", "AT", "At"]), rng.choice(["dot", "dot", "DOT", "Dot"])
    left, right = rng.choice(["[]", "()", "{}", "<>"])
    abroad, mobile = rng.choice(["33", "49", "34", "44"]), rng.choice("1567")
    personal = [
        ("bracketed address", "email", f"{a(5)}{rng.choice(['', '.', '_'])}{a(4)} {left}{at}{right} {a(6)} {rng.choice([left + dot + right, '.'])} {ending}"),
        ("tight address", "email", f"{a(6)}{left}{at}{right}{a(5)}.{ending}"),
        ("spoken address", "email", f"{a(5)}{rng.choice(['', '.', '_'])}{a(4)} {at} {a(7)} {dot} {ending}"),
        ("area code in brackets", "phone", f"({d(3)}) {d(3)}-{d(4)}"),
        ("three groups", "phone", f"{rng.choice('23456789')}{d(2)}{sep}{d(3)}{sep}{d(4)}"),
        ("00 in threes", "phone", f"00{abroad} {d(3)} {d(3)} {d(3)}"),
        ("00, area, number", "phone", f"00{abroad}{rng.choice(' -/')}{d(rng.randrange(1, 4))}{rng.choice(' -')}{d(rng.randrange(6, 8))}"),
        ("0 in pairs", "phone", f"0{rng.choice('1234567')} {d(2)} {d(2)} {d(2)} {d(2)}"),
        ("0 prefix, number", "phone", f"0{mobile}{d(rng.randrange(1, 3))}{rng.choice([' ', '-', '/'])}{d(rng.randrange(6, 9))}"),
        ("full IPv6", "ip", x(8)),
        ("short IPv6", "ip", f"{rng.choice(['2001', 'fe80', '2a02', 'fd00'])}:{x(rng.randrange(1, 3))}::{x(rng.randrange(1, 4))}"),
        ("IPv6 of a short host", "ip", f"{rng.choice(['fe80', 'fd00', '2a02:' + x(1), '2001:db8'])}::{rng.randrange(1, 4096):x}"),
    ]
    body = rng.choice("3456") + d(14)
    card = body + next(c for c in "0123456789" if luhn(body + c))
    personal.append(("card of other separators", "card", rng.choice("./_").join(card[i : i + 4] for i in range(0, 16, 4))))
    other = [
        ("date and hour", "phone", f"{rng.randrange(1900, 2030)}-{d(2)}-{d(2)} {d(2)}"),
        ("digits", "phone", d(rng.randrange(7, 16))),
        ("thousands", "phone", f"{d(2)}.{d(3)}.{d(3)}"),
        ("fours", "phone", f"{d(4)} {d(4)} {d(2)}"),
        ("loose groups", "phone", f"{d(1)} {d(2)} {d(1)} {d(3)} {d(2)}"),
        ("date", "phone", f"{d(2)}/{d(2)}/{rng.randrange(1900, 2030)}"),
        ("isbn", "phone", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
        ("two numbers", "phone", f"{rng.choice('123456789')}{d(rng.randrange(1, 4))} {d(rng.randrange(6, 9))}"),
        ("zero-filled number", "phone", f"00{d(rng.randrange(5, 9))}"),
        ("long digits", "card", d(rng.randrange(13, 20))),
        ("dotted fours", "card", f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"),
        ("groups of a code", "card", f"{d(3)} {d(5)} {d(5)} {d(3)}"),
        ("handle", "email", f"{a(5)} @ {a(5)}. {a(4)}"),
        ("mention", "email", f"{a(5)} @{a(5)}. {a(6)}"),
        ("everyday at and dot", "email", f"{rng.choice(['look', 'point', 'stare', 'arrow'])} at {rng.choice(['this', 'that', 'the', 'one'])} dot {rng.choice(['and', 'here', 'then', 'on', 'below'])}"),
        ("scope", "ip", f"{rng.choice(['a', 'ab', 'abc', 'dead', 'face'])}::{rng.choice(['add', 'b', 'bad', 'cafe'])}"),
        ("range", "ip", f"{d(2)}::{d(2)}"),
    ]
    label = int(rng.random() < 0.5)
    family, kind, s = rng.choice(personal if label else other)
    if kind == "card" and not label and luhn(re.sub(r"\D", "", s)):
        label = int(not s.isdigit())
    hint = {"phone": ["tel ", "phone: ", "call "], "email": ["mail: ", "contact "], "card": ["card ", "visa: "], "ip": ["host "]}[kind]
    lead = rng.choice(hint) if label and rng.random() < 0.4 else rng.choice(["no. ", "total ", "order ", "version ", "= ", "#"]) if not label and rng.random() < 0.4 else ""
    return family, kind, lead, s, label


def _material(docs: DataFrame, p: PrivacyParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, held out, family of the form) of the candidates that the model is learned from."""
    taken = bounded_sample(docs.select(F.substring("text", 1, p.context_chars).alias("text")), "text", p.context_docs) or ["text"]
    rng = random.Random(p.seed)
    rng.shuffle(taken)
    held_out = [k % 4 == 0 and len(taken) > 3 for k in range(len(taken))]
    places: dict[tuple[str, bool], list[tuple[int, int, int]]] = {}  # base spans: (document, start, end)
    rows, labels, held, families = [], [], [], []
    for k, text in enumerate(taken):
        base = base_spans(text)
        for kind, a, b in base:
            places.setdefault((kind, held_out[k]), []).append((k, a, b))
        covered = _union([(a, b) for _, a, b in base])
        for kind, a, b in candidates(text):
            if kind == "card" and not _meets(covered, a, b) and not luhn(re.sub(r"\D", "", text[a:b])):
                rows.append(features(text, kind, a, b)), labels.append(0), held.append(held_out[k]), families.append("sample")
    for n in range(p.sample_rows):
        family, kind, lead, s, label = _planted(rng)
        k = rng.randrange(len(taken))
        there = places.get((kind, held_out[k]))
        if label and there and n % 2:
            k, a, b = rng.choice(there)
            lead = ""
        else:
            a = b = rng.randrange(len(taken[k]) + 1)
            gap = taken[k].find(" ", a)
            a = b = gap + 1 if gap >= 0 else a
            lead, s = (lead if not a or taken[k][a - 1].isspace() else " " + lead), s + " "
        text = taken[k][max(0, a - 40) : a] + lead + s + taken[k][b : b + 40]
        a = min(a, 40) + len(lead)
        rows.append(features(text, kind, a, a + len(s.rstrip()))), labels.append(label), held.append(held_out[k]), families.append(family)
    held = np.array(held)
    if not held.any():  # too few documents to hold any out
        held = np.arange(len(labels)) % 4 == 0
    return np.array(rows, float), np.array(labels), held, np.array(families)


def fit(docs: DataFrame, p: PrivacyParams = PrivacyParams()) -> dict:
    """The model and its thresholds from a bounded sample."""
    x, y, held, _ = _material(docs, p)
    return _fitted(x, y, held, p)


def _fitted(x: np.ndarray, y: np.ndarray, held: np.ndarray, p: PrivacyParams) -> dict:
    model = boosting.fit(x[~held], y[~held])
    scores, x, y = boosting.predict(model, x[held]), x[held], y[held]
    model["limits"], model["held_out"] = [], {}
    for i, kind in enumerate(KINDS):
        own = x[:, 0] == i
        limit = boosting.calibrated_threshold(scores[own], y[own], p.precision)
        chosen = own & (scores >= limit)
        model["limits"].append(limit)
        model["held_out"][kind] = {"rows": int(own.sum()), "precision": float(y[chosen].mean()) if chosen.any() else None, "recall": float(y[chosen].sum() / max(y[own].sum(), 1))}
    return model


def left_out(docs: DataFrame, p: PrivacyParams = PrivacyParams(), families: list[str] | None = None) -> dict[str, dict]:
    """Per family of forms, how a model that has seen none of it decides on it: the share of the family's personal
    candidates that it selects, and of its look-alikes (null where the family has none)."""
    x, y, held, family = _material(docs, p)
    out = {}
    for name in families or sorted(set(family.tolist())):
        own = family == name
        model = _fitted(x[~own], y[~own], held[~own], p)
        chosen = boosting.predict(model, x[own]) >= np.array(model["limits"])[x[own][:, 0].astype(int)]
        share = {kind: float(chosen[y[own] == label].mean()) if (y[own] == label).any() else None for label, kind in ((1, "personal"), (0, "look_alike"))}
        out[name] = {"rows": int(own.sum()), **share}
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _meets(disjoint: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a span shares a character with one of disjoint spans in order."""
    k = bisect_left(disjoint, (b, -1))  # the first that starts at b or later
    return k > 0 and disjoint[k - 1][1] > a


def _select(texts: list, model: dict) -> list[list[dict]]:
    """All spans of every text: the base ones and the selected candidates."""
    out, taken, owners, rows = [], [], [], []
    for i, text in enumerate(texts):
        spans, covered = [], []
        if text and _ANY.search(text):
            spans = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base_spans(text)]
            covered = _union([(s["start"], s["end"]) for s in spans])
            for kind, a, b in candidates(text):
                if not _meets(covered, a, b):
                    owners.append((i, kind, a, b))
                    rows.append(features(text, kind, a, b))
        out.append(spans)
        taken.append(covered)
    if rows:
        scores = boosting.predict(model, np.array(rows, float))
        for k in np.argsort(-scores, kind="stable"):
            i, kind, a, b = owners[k]
            if scores[k] >= model["limits"][KINDS.index(kind)] and not _meets(taken[i], a, b):
                out[i].append({"kind": kind, "start": a, "end": b, "base": False})
                taken[i].insert(bisect_right(taken[i], (a, b)), (a, b))
    for spans in out:
        spans.sort(key=lambda s: (KINDS.index(s["kind"]), s["start"]))
    return out


def with_spans(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with an array `spans`, ordered by kind as listed in KINDS, then start."""

    @F.pandas_udf(SPAN_TYPE)
    def spans(text: pd.Series) -> pd.Series:
        return pd.Series(_select(text.tolist(), model))

    return docs.withColumn("spans", spans("text"))


def _covered(text: str | None, spans: list[dict]) -> str | None:
    """`text` with each span, or union of overlapping spans, replaced by the kind of its first one."""
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]]) if parts else text


def redacted(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with every span of the text replaced by its kind in brackets; its columns stay."""

    @F.pandas_udf("string")
    def cover(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        return pd.Series([_covered(t, spans) for t, spans in zip(texts, _select(texts, model))])

    return docs.withColumn("text", cover("text"))
