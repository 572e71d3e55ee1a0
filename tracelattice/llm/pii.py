"""Personal data: candidate spans by high-recall generators, boosted trees with calibrated thresholds choose redactions.

Plain spans (valid emails, ip addresses, cards, phones) always count. Beside them generators propose overlapping spans of
each kind: numbers without their check marks, grouped otherwise, obfuscated addresses. Boosted trees score a proposal by
format and context; those whose calibrated probability passes the threshold of their kind, and that overlap no plain span,
are added. The trees learn from a bounded sample of documents: a proposal is positive if it is a plain span of its kind;
the marks that decide plain spans (leading plus, check digit, number range) are no features.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.llm.boosting import Trees, calibrate, fit_trees, precise_threshold
from tracelattice.llm.common import hash_sample, map_rows, whole_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PLAIN = {  # A digit run is always taken from its start, hence the look-behind; it keeps long runs linear.
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
HINTS = {
    "email": ("mail", "contact", "write", "correo"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte"), "phone": ("call", "phone", "tel", "mobile", "fax"),
}
NUMBERS = re.compile(r"[+(]?[0-9](?:[\x20().+-]?[0-9()]){6,30}")
DOTTED = re.compile(r"[0-9]++(?:[.:]\x20?[0-9]++){3,}")
HIDDEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[({]\x20?dot\x20?[\])}]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}")
MAILISH = re.compile(r"(?<![^\x20\n\t<>,;:()])[A-Za-z0-9._%+-]{1,64}\x20?@\x20?[A-Za-z0-9.-]{1,100}")
SAMPLE_DOCS, SAMPLE_SPANS, PRECISION = 4000, 20_000, 0.95


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def plain_emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            low = found.end()
        else:
            low = at + 1
        at = text.find("@", low)
    return out


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all plain spans, by kind, then start."""
    out = [(0, s, e) for s, e in plain_emails(text)] if "@" in text else []
    for m in PLAIN["ip"].finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in PLAIN["card"].finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PLAIN["phone"].finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals of all generators, each once, by start."""
    out = set()
    for m in NUMBERS.finditer(text):
        s, e = m.span()
        while e > s and not text[e - 1].isdigit():
            e -= 1
        digits = sum("0" <= c <= "9" for c in text[s:e])
        if 8 <= digits <= 15:
            out.add((3, s, e))
        if 13 <= digits <= 19:
            s += text[s] in "+("
            out.add((2, s, e))
    for m in DOTTED.finditer(text):
        out.add((1, *m.span()))
    if "@" in text:
        out.update((0, *m.span()) for m in MAILISH.finditer(text))
    out.update((0, *m.span()) for m in HIDDEN.finditer(text))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def char_class(c: str) -> int:
    return 0 if not c or c.isspace() else 3 if c.isdigit() else 2 if c.isalpha() else 1


def features(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Format of each proposed span and of the text around it."""
    rows = []
    for kind, s, e in spans:
        body = text[s:e].lstrip("+")
        groups = re.findall(r"[0-9]+", body)
        before = text[max(0, s - 40) : s].lower()
        sizes = [len(g) for g in groups] or [0]
        previous = before.split()[-1:] or [""]
        rows.append([
            kind, len(body), sum(sizes), sum(c.isalpha() for c in body), body.count(" "), body.count("-"), body.count("."),
            body.count("(") + body.count("["), len(groups), sizes[0], sizes[-1], max(sizes), len(set(body)) / max(len(body), 1),
            char_class(text[s - 1 : s] if s else ""), char_class(text[e : e + 1]), len(previous[0]),
            any(h in before for h in HINTS[KINDS[kind]]), any(h in before for k, hs in HINTS.items() if k != KINDS[kind] for h in hs),
            len(re.findall(r"[0-9]", before)), body.count("@") + body.count("at"),
        ])
    return np.array(rows, float).reshape(len(rows), 20)


def same_span(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    inner = min(a[2], b[2]) - max(a[1], b[1])
    return a[0] == b[0] and inner >= 0.9 * (max(a[2], b[2]) - min(a[1], b[1]))


def hinted(text: str, kind: int, s: int) -> bool:
    """Does a word of the kind's context stand shortly before?"""
    before = text[max(0, s - 40) : s].lower()
    return any(h in before for h in HINTS[KINDS[kind]])


def told_apart(text: str, span: tuple[int, int, int], base: list[tuple[int, int, int]]) -> int | None:
    """1: a plain span. 0: surely none of its kind. None: no rule can tell, so that it teaches nothing.

    Surely none are parts of plain spans of other kinds; digit runs without separators or context; numbers of card length that
    fail Luhn, without context; dotted numbers with a part over 255 or more than four parts; addresses without a word as last label.
    """
    kind, s, e = span
    if any(same_span(span, b) for b in base):
        return 1
    if any(b[0] != kind and b[1] < e and s < b[2] for b in base):
        return 0
    body = text[s:e]
    groups = re.findall(r"[0-9]+", body)
    if kind == 0:
        return None if re.search(r"[A-Za-z]{2}$", body) else 0
    if kind == 1:
        return 0 if len(groups) > 4 or any(len(g.lstrip("0")) > 3 or int(g) > 255 for g in groups) else None
    if hinted(text, kind, s):
        return None
    if kind == 2 and not luhn("".join(groups)):
        return 0
    return 0 if len(groups) == 1 else None


def unmarked(text: str, span: tuple[int, int, int]) -> tuple[str, tuple[int, int, int]] | None:
    """The text with a plain span as people write it to hide it or without thought: a phone number without its plus, an address
    with `[at]` for the sign. Every other one also loses the words before it."""
    kind, s, e = span
    body = text[s:e].lstrip("+") if kind == 3 else text[s:e].replace("@", " [at] ", 1) if kind == 0 else None
    if body is None:
        return None
    lead = text[max(0, s - 60) : s] if (s + e) % 2 else "and "
    return lead + body + text[e : e + 20], (kind, len(lead), len(lead) + len(body))


def training_rows(docs: DataFrame, sample_docs: int, sample_spans: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and part (0 fit, 1 calibrate) of proposals in the documents of smallest hash: those that can be told apart,
    and plain spans with their marks taken away."""
    chosen = hash_sample(docs.select("doc_id", "text"), sample_docs, "doc_id", "text")
    chosen = chosen.select(F.xxhash64("doc_id", "text").alias("r"), whole_text().alias("t"))

    def rows(c):
        out: dict[str, list] = {"r": [], "at": [], "y": [], "x": []}

        def add(r, at, y, x):
            for name, value in zip(out, (r, at, y, x)):
                out[name].append(value)

        for r, t in zip(c["r"], c["t"]):
            text = t.decode()
            base, spans = plain_spans(text), proposals(text)
            for i, (span, x) in enumerate(zip(spans, features(text, spans).tolist())):
                y = told_apart(text, span, base)
                if y is not None:
                    add(r, i, y, x)
            for i, span in enumerate(base):
                bare = unmarked(text, span)
                if bare:
                    add(r, -1 - i, 1, features(bare[0], [bare[1]])[0].tolist())
        return out

    got = map_rows(chosen, rows, "r long, at int, y int, x array<double>").orderBy(F.xxhash64("r", "at"), "r", "at").limit(sample_spans).toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    part = (np.array(got.column("r").to_pylist(), np.int64) % 3 == 0).astype(int)
    return np.array(got.column("x").to_pylist(), float).reshape(len(y), 20), y, part


def fit_redactor(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS, precision: float = PRECISION) -> tuple[Trees | None, list[float]]:
    """Calibrated trees and a threshold per kind that kept `precision` on held-out proposals. None without both classes: then
    nothing is added to the plain spans. Nulls and repeated rows do no harm; of very long texts all proposals may be drawn."""
    x, y, part = training_rows(docs, sample_docs, sample_spans)
    fit, held = part == 0, part == 1
    if len(set(y[fit])) < 2 or len(set(y[held])) < 2:
        return None, [2.0] * len(KINDS)
    model = fit_trees(x[fit], y[fit])
    calibrate(model, x[held], y[held])
    p = model.probability(x[held])
    thresholds = []
    for k in range(len(KINDS)):
        of = x[held][:, 0] == k
        thresholds.append(max(0.5, precise_threshold(p[of], y[held][of], precision)) if of.any() else 2.0)
    return model, thresholds


def chosen_spans(text: str, model: Trees | None, thresholds: list[float]) -> tuple[list, list]:
    """Plain spans, and all spans with the added ones; sorted by kind, then start."""
    base = plain_spans(text)
    spans = proposals(text) if model else []
    if not spans:
        return base, base
    p = model.probability(features(text, spans))
    taken = [(s, e) for _, s, e in base]
    added = []
    for q, (k, s, e) in sorted(zip(p.tolist(), spans), key=lambda z: (-z[0], z[1][1], z[1][2], z[1][0])):
        if q >= thresholds[k] and all(e <= a or s >= b for a, b in taken):
            taken.append((s, e))
            added.append((k, s, e))
    return base, sorted(base + added)


def find_pii(docs: DataFrame, model: Trees | None = None, thresholds: list[float] | None = None, mask: str = "[{}]") -> DataFrame:
    """doc_id, plain and spans (kind:start:end, code points, end exclusive, comma-joined), n_<kind> of plain spans, redacted text.

    One row per row of `docs` (doc_id, text). Null and empty texts have no spans and an empty redacted text. Texts are read
    whole, whatever their length. Where spans of two kinds overlap, the redaction masks their union under the first kind.
    Repeated rows give repeated results; other columns are left aside; an empty table gives an empty result.
    """
    thresholds = thresholds or [2.0] * len(KINDS)

    def rows(c):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "plain", "spans", "redacted")}
        for d, t in zip(c["doc_id"], c["t"]):
            text = t.decode()
            base, spans = chosen_spans(text, model, thresholds)
            out["doc_id"].append(d)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(x[0] == k for x in base))
            out["plain"].append(joined(base))
            out["spans"].append(joined(spans))
            out["redacted"].append(redacted(text, spans, mask))
        return out

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, plain string, spans string, redacted string"
    return map_rows(docs.select("doc_id", whole_text().alias("t")), rows, ddl)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans, mask: str) -> str:
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], mask.format(KINDS[k])]
        at = max(at, e)
    return "".join(out) + text[at:]
