"""Personal data: generators propose, boosted trees judge, calibrated thresholds select.

Generators are generous and their spans overlap. Every candidate is described by its format and its context; boosted
trees, fitted on a bounded sample, give a score, which is calibrated on candidates kept out of fitting. They learn from
the strict formats, from copies of the sample's texts in which a strict span has lost a format mark, and from keys planted
with and without a hint word before them. Per kind the threshold is the lowest at which calibrated precision suffices. Spans in a strict format are
always selected; the trees add to them and never take one away."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, tidied

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "key")
#: Nothing can be found in a text without a digit or an @.
GATE = "[0-9@]"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only, which changes no match and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: a match starts where the run of local characters before it starts."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans in a strict format: by kind, then by start; offsets in code points, end exclusive."""
    spans: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
              if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


_GENERATORS = (
    ("email", re.compile(r"[^\s@<>\"'()]{1,64}@[^\s@<>\"'()]{1,128}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){2,5}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ .\-/]?[0-9]){11,21}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+|\()?[0-9](?:[ ().\-/]{0,2}[0-9]){5,15}(?![0-9])")),
    ("key", re.compile(r"(?<![A-Za-z0-9_\-])(?=[A-Za-z_\-]{0,64}[0-9])[A-Za-z0-9_\-]{20,512}(?![A-Za-z0-9_\-])")),
)
_HINTS = ("mail", "phone", "tel", "call", "card", "visa", "ip", "host", "token", "key", "secret", "password")
_MAX_BEFORE = 32
#: The hint words that speak for a kind: a loose candidate after one of them is not known to be clean.
_SPEAKS = {"email": ("mail",), "ip": ("ip", "host"), "card": ("card", "visa"), "phone": ("phone", "tel", "call"),
           "key": ("token", "key", "secret", "password")}
_KEY_LEADS = ("token = \"", "token=", "key: ", "api_key=", "secret ", "secret: ", "password=")
_KEY_HEADS = ("", "", "sk_live_", "ghp_", "AKIA")
_KEY_SIGNS = ("0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
              "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-")


def candidates(text: str) -> list[Span]:
    """All proposals of all generators. They may overlap within and between kinds."""
    return [(kind, m.start(), m.end()) for kind, pattern in _GENERATORS if kind != "email" or "@" in text
            for m in pattern.finditer(text)]


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate. The checks that define the strict formats are not among them."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - _MAX_BEFORE):start], text[end:end + 2]
    digits = sum("0" <= c <= "9" for c in body)
    letters = sum(c.isalpha() for c in body)
    groups = re.findall("[0-9]+", body)
    near = before.lower()
    tail = body.rpartition(".")[2]
    return [
        KINDS.index(kind), len(body), digits, letters, digits / len(body), len(groups), max(map(len, groups), default=0),
        min(map(len, groups), default=0), body.count("."), body.count("-"), body.count(" "), body.count("("),
        body.count("@"), body[0] == "+", len(tail), tail.isalpha(), sum(int(g[-4:]) > 255 for g in groups),
        len({*body}) / len(body), all(c in "0123456789abcdefABCDEF" for c in body),
        not before or before[-1].isspace(), bool(before) and before[-1] in "=:\"'", bool(before) and before[-1].isalnum(),
        not after or after[0].isspace(), bool(after) and after[0] in ".,;\"'", bool(after) and after[0].isalnum(),
        sum(c.isdigit() for c in before), *(hint in near for hint in _HINTS),
    ]


def hinted(text: str, span: Span) -> bool:
    near = text[max(0, span[1] - _MAX_BEFORE):span[1]].lower()
    return any(hint in near for hint in _SPEAKS[span[0]])


def loosened(kind: str, body: str, rnd: random.Random) -> str:
    """A strict span with a format mark taken away or changed: a phone number without its +, an email without the last
    dot, a card number in groups apart by dots or slashes. Nothing like it is known for addresses."""
    if kind == "phone":
        return body[1:] if rnd.random() < 0.5 else body[1:].replace(" ", rnd.choice(".-"))
    if kind == "email":
        return body.rpartition(".")[0]
    if kind == "card":
        digits = _NOT_DIGIT.sub("", body)
        return rnd.choice("./").join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return body


def planted(text: str, number: int) -> list[tuple[str, Span, bool]]:
    """At most two copies of a text, each with one span and whether it is personal: a strict span loosened, and a key put
    in at a blank, after a hint word, or without one, which is an identifier like any other. The same on every run."""
    rnd, out = random.Random(number), []
    strict = [s for s in base_spans(text) if s[0] != "ip"]
    if strict:
        kind, a, b = rnd.choice(strict)
        body = loosened(kind, text[a:b], rnd)
        out.append((text[:a] + body + text[b:], (kind, a, a + len(body)), True))
    at = text.find(" ", rnd.randrange(len(text))) + 1
    good = rnd.random() < 0.5
    lead = rnd.choice(_KEY_LEADS) if good else rnd.choice(("", "\""))
    signs = rnd.choice(_KEY_SIGNS)
    body = rnd.choice(_KEY_HEADS) + "".join(rnd.choices(signs, k=rnd.randint(24, 64)))
    copy = text[:at] + lead + body + ("\" " if lead.endswith("\"") else " ") + text[at:]
    span = ("key", at + len(lead), at + len(lead) + len(body))
    if good or not hinted(copy, span):
        out.append((copy, span, good))
    return [o for o in out if o[1] in candidates(o[0]) and o[1] not in base_spans(o[0])]


@dataclass
class BoostedTrees:
    """Trees of depth three over binned features, logistic loss. splits[t] holds a feature and a bin for each of seven
    nodes, leaves[t] eight values; edges[f] are the bin borders of a feature."""

    edges: list[np.ndarray]
    splits: np.ndarray
    leaves: np.ndarray
    bias: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for split, leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (bins[rows, split[node, 0]] > split[node, 1])
            out += leaf[node - 7]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.2, bins: int = 32) -> BoostedTrees:
    """Second-order boosting with histograms."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    model = BoostedTrees(edges, np.zeros((0, 7, 2), np.int64), np.zeros((0, 8)), 0.0)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model.bias = float(np.log(share / (1 - share)))
    binned = model.binned(x)
    margin = np.full(len(x), model.bias)
    splits, leaves = [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        split, leaf = np.zeros((7, 2), np.int64), np.zeros(8)
        node = np.zeros(len(x), np.int64)
        for n in range(7):
            split[n] = _best_split(binned, grad, hess, np.flatnonzero(node == n), bins)
            mine = node == n
            node[mine] = 2 * n + 1 + (binned[mine, split[n, 0]] > split[n, 1])
        for k in range(8):
            mine = node == k + 7
            if mine.any():
                leaf[k] = -rate * grad[mine].sum() / (hess[mine].sum() + 1.0)
        margin += leaf[node - 7]
        splits.append(split)
        leaves.append(leaf)
    model.splits, model.leaves = np.array(splits), np.array(leaves)
    return model


def _best_split(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, bins: int) -> tuple[int, int]:
    best, where = 1e-9, (0, bins)
    total_g, total_h = grad[rows].sum(), hess[rows].sum()
    for f in range(binned.shape[1] if len(rows) > 1 else 0):
        g = np.cumsum(np.bincount(binned[rows, f], grad[rows], bins + 1))
        h = np.cumsum(np.bincount(binned[rows, f], hess[rows], bins + 1))
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        at = int(gain.argmax())
        if gain[at] > best:
            best, where = gain[at], (f, at)
    return where


@dataclass
class PiiModel:
    """Trees, the calibration as a rising step function of their margin, and a threshold for each kind. Without trees
    only the strict formats count."""

    trees: BoostedTrees | None
    margins: np.ndarray
    precision: np.ndarray
    thresholds: dict[str, float]

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.margins, margin, side="right") - 1
        return np.where(at >= 0, self.precision[np.maximum(at, 0)], 0.0)


def _isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators, with one imagined negative in each block so that small blocks stay modest."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, label in zip(margin[order], y[order], strict=True):
        blocks.append([m, label, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, good, n = blocks.pop()
            blocks[-1][1] += good
            blocks[-1][2] += n
    values = [b[1] / (b[2] + 1) for b in blocks]
    return np.array([b[0] for b in blocks]), np.maximum.accumulate(np.array(values)) if values else np.array([])


def fit_pii(docs: DataFrame, rows: int = 4000, longest: int = 20_000, precision: float = 0.98, pool: int = 50_000) -> PiiModel:
    """Fit on at most `rows` texts of at most `longest` characters that hold a digit or an @, the lowest by a hash of
    doc_id out of a hashed sample of about `pool` documents. A candidate is positive where it is a strict span, negative
    where it touches none and no hint word of its kind stands before it; the rest teach nothing. To these come the spans
    planted in copies of a text, at most two each, of which nothing else counts. Every third document calibrates."""
    hashed = F.xxhash64("doc_id")
    sample = docs.select("doc_id", "text").filter(hash_share(hashed, pool / max(1, docs.count())))
    sample = sample.filter(F.length("text").between(1, longest) & F.col("text").rlike(GATE))
    texts = sample.orderBy(hashed, "doc_id", "text").limit(rows).select("text").collect()  # bounded
    x, y, fold = [], [], []
    for number, (text,) in enumerate(texts):
        strict = base_spans(text)
        known = set(strict)
        for span in candidates(text):
            touches = any(a < span[2] and span[1] < b for _, a, b in strict)
            if span in known or not touches and not hinted(text, span):
                x.append(features(text, span))
                y.append(span in known)
                fold.append(number % 3)
        for copy, span, good in planted(text, number):
            x.append(features(copy, span))
            y.append(good)
            fold.append(number % 3)
    return train(np.array(x, float), np.array(y, float), np.array(fold) == 0, precision)


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float) -> PiiModel:
    """Trees from the rows not held, calibration and thresholds from those held."""
    nothing = PiiModel(None, np.array([]), np.array([]), {})
    if len(x) < 50 or not 0 < y[~held].sum() < (~held).sum() or not held.any():
        return nothing
    trees = fit_trees(x[~held], y[~held])
    margin = trees.margin(x[held])
    model = PiiModel(trees, *_isotonic(margin, y[held]), {})
    scores = model.calibrated(margin)
    for number, kind in enumerate(KINDS):
        mine = x[held][:, 0] == number
        order = np.argsort(-scores[mine], kind="stable")
        ranked, hits = scores[mine][order], np.cumsum(y[held][mine][order])
        good = [s for i, s in enumerate(ranked) if (hits[i] / (i + 1) >= precision and s >= precision
                                                    and (i + 1 == len(ranked) or ranked[i + 1] < s))]
        if good:
            model.thresholds[kind] = float(min(good))
    return model


def select_spans(text: str, model: PiiModel) -> list[tuple[str, int, int, bool, float]]:
    """Kind, start, end, whether the format is strict, score; by kind as listed, then by start. Strict spans are
    always there; of the others, best first, those above their kind's threshold that touch no span taken."""
    strict = base_spans(text)
    taken = [(a, b) for _, a, b in strict]
    out = [(kind, a, b, True, 1.0) for kind, a, b in strict]
    proposed = [s for s in candidates(text) if s[0] in model.thresholds] if model.trees else []
    if proposed:
        scores = model.calibrated(model.trees.margin(np.array([features(text, s) for s in proposed], float)))
        for i in np.argsort(-scores, kind="stable"):
            kind, a, b = proposed[i]
            if scores[i] >= model.thresholds[kind] and not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
                out.append((kind, a, b, False, float(scores[i])))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = "array<struct<kind: string, start: bigint, `end`: bigint, strict: boolean, score: double>>"


def find_pii(df: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans of every whole text. Offsets are code points, end exclusive. A null or empty text has no
    spans. Texts without a digit or an @ cannot hold any and never leave the JVM. Only the two named columns are
    read. Repeated rows stay repeated."""
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("score", pa.float64())])
    names = [f.name for f in item]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in select_spans(t, model)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["id", "spans"])

    text = F.col(text_col)
    picked = df.select(F.col(id_col).alias("id"), F.when(text.rlike(GATE), text).alias("text"))
    return picked.mapInArrow(tidied(find), f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets. Spans that overlap become one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_column(text: Column, model: PiiModel) -> Column:
    """A text column with its personal data redacted; a null text stays null."""
    @F.pandas_udf("string")
    @tidied
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: redact(t, [s[:3] for s in select_spans(t, model)]) if isinstance(t, str) else None)

    return F.when(text.rlike(GATE), apply(text)).otherwise(text)
