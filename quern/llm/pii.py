"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

Base spans are those of four patterns (email, ip, card, phone) over the whole text, leftmost and without overlap within a kind;
matches that fail their check (parts of an address at most 255, Luhn sum, number of digits) are dropped without a retry.

The field labels tokens (runs of letters, runs of digits, single signs) with begin and inside labels of the four kinds.  Its
features are the shapes of a token and of two on either side, each with whether white space comes before.  It is trained from
TRAINING, a small table of marked sentences that are filled with invented values, by the gradient of the log-likelihood, and
decoded by Viterbi over padded batches.  Spans that it finds are added if they touch no base span and hold what their kind
needs (an address with a dot after the at, four parts, a Luhn sum, enough digits).  Each of these needs a digit, an @, the
word dot, an at in brackets or one before a dotted name, so tokens more than WINDOW away from one are not decoded; texts without any are told by a scan
of their bytes.

Cases: null text is empty text and has no spans; repeated rows are reported each; of spans that start alike in one kind the
shorter comes first; a digit is 0-9 only; offsets are code points, ends exclusive; an empty table gives an empty result; only
the id and text columns are read, so other columns may have any names.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import chunks, table, utf8

KINDS = ("email", "ip", "card", "phone")
WINDOW, CONTEXT = 16, 2

# --- base patterns --------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a search that starts inside a run of digits can't find what one at its start doesn't: the look-behind keeps it linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _address(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _card(text: str) -> bool:
    d = _digits(text)
    return 13 <= len(d) <= 19 and luhn(d)


def _phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @: the part before it can't hold one."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at and at >= end else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {
        "email": _emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if _address(m[0])],
        "card": [m.span() for m in _CARD.finditer(text) if _card(m[0])],
        "phone": [m.span() for m in _PHONE.finditer(text) if _phone(m[0])] if "+" in text else [],
    }


# --- the field --------------------------------------------------------------------------------------------------------

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_SIGNS = "@.-+()[]{}<>:/,_=\"'#$%*!?;&|~^"
_WORDS = ("at", "dot", "com", "org", "net", "edu", "example", "phone", "tel", "call", "mobile", "fax", "card", "visa", "credit", "ip", "address", "server", "host", "email", "mail", "contact", "write", "reach", "order", "invoice", "version", "id", "token", "number", "date", "page", "ext",
          "release", "build", "section", "chapter", "serial", "model", "part", "case", "ticket", "ref", "reference", "isbn", "zip", "code", "account", "tracking", "text", "dial", "ring", "cell", "paid", "charged", "ping", "ssh", "de", "fr", "es", "io", "uk", "to", "on", "no", "the", "is", "and", "was")
_SHAPES = {x: i for i, x in enumerate(["<edge>", "lower1", "lower", "title", "upper", "mixed", *(f"d{n}" for n in range(1, 20)), "d20", "other", *_SIGNS, *_WORDS])}
N_VALUES = 2 * len(_SHAPES)


def _shape(token: str) -> int:
    c = token[0]
    if "0" <= c <= "9":
        return _SHAPES[f"d{min(len(token), 20)}"]
    low = token.lower()
    if low in _SHAPES and len(low) > 1 and low in _WORDS:
        return _SHAPES[low]
    if c.isalpha():
        return _SHAPES["lower1" if len(token) == 1 else "lower" if token.islower() else "title" if token.istitle() else "upper" if token.isupper() else "mixed"]
    return _SHAPES.get(c, _SHAPES["other"])


def tokens(text: str, start: int = 0, end: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans and shape values; a value is odd if white space, or an edge, comes before."""
    spans, values, last = [], [], -1
    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        spans.append(m.span())
        values.append(2 * _shape(m[0]) + (m.start() != last))
        last = m.end()
    return spans, np.array(values, np.int64)


#: Marked sentences: {kind:pattern} is a span; in patterns a is a word, 9 a digit, C a card number with a right Luhn sum,
#: B a number from 0 to 255, T the end of a domain.  Outside of spans a and 9 are filled as well after a backslash.
TRAINING = [
    "write to {email:a at a dot T} soon", "contact {email:a [at] a [dot] T} for more", "mail {email:a (at) a (dot) T}", "{email:a dot a at a dot T}", "reach me : {email:a @ a . T}",
    "email {email:a99 at a dot T} or call", "send it to {email:a_a at a dot T}, thanks", "address {email:a [at] a.T} here", "{email:a (at) a.T} \\a \\a", "\\a \\a {email:a AT a DOT T} \\a",
    "email: {email:a at a dot a dot T}.", "\\a {email:a-a at a-a dot T} \\a",
    "call {phone:999-999-9999} today", "tel {phone:(999) 999-9999}", "phone : {phone:999.999.9999} \\a", "mobile {phone:999 999 9999}", "fax {phone:00 99 99 9999 9999}", "\\a {phone:(999) 999 9999} \\a",
    "{phone:999-999-9999} \\a \\a \\a", "phone {phone:9999 999 9999}", "tel. {phone:0999-9999999}", "number {phone:999-999-9999} ext 99", "\\a \\a call {phone:9-999-999-9999} .",
    "card {card:C4.} \\a", "visa {card:C4.} expires 99/99", "credit card number {card:C4/}", "\\a card {card:C4_} \\a", "paid with card {card:C4.}.", "card : {card:C4/} \\a",
    "server {ip:B . B . B . B} down", "ip {ip:B [.] B [.] B [.] B}", "host {ip:B[.]B[.]B[.]B} \\a", "address {ip:B(.)B(.)B(.)B}", "ip : {ip:B dot B dot B dot B} \\a", "\\a \\a {ip:B[.]B[.]B[.]B} \\a",
    "ring {phone:999-999-9999} after \\9", "cell {phone:999.999.9999}", "dial {phone:(999) 999-9999} and \\a", "text me at {phone:999-999-9999} \\a", "my number is {phone:999 999 9999}", "reach \\a on {phone:999-9999-9999}",
    "\\a, {email:a at a dot T}, \\a", "ping {email:a [at] a.T}", "<{email:a at a dot T}>", "\\a or {email:a.a at a dot T} \\a", "\\a \\a: {email:a at a.T}", "\\a ({email:a at a dot T})", "mail to {email:a at a.T} \\a",
    "ssh {ip:B . B . B . B}", "\\a from {ip:B[.]B[.]B[.]B}, \\a", "\\a {ip:B . B . B . B} \\a", "charged {card:C4.} \\a", "\\a \\a {card:C4.} \\a", "paid by {card:C4_}, \\a", "card no {card:C4/}",
    "\\a \\a to {email:a at a dot T} \\a \\a", "the \\a is {email:a at a dot T} and \\a", "\\a \\a {email:a at a dot T} \\a \\a", "phone , {phone:999 999 9999} , \\a", "the \\a ( {ip:B . B . B . B} ) is \\a", "\\a ? {email:a at a.T}", "\\a ( {ip:B . B . B . B} )", "\\a : {phone:999 999 9999} ,",
    "{phone:+9 (999) 999-9999} {card:C4} \\a", "\\a {phone:+9 (999) 999-9999} {card:C4}", "{email:a.a99@a.T} {phone:+9 (999) 999-9999} {card:C4} \\a", "{phone:+99 999 999 9999} {card:C4 }", "{card:C4} {phone:+9 (999) 999-9999} \\a", "\\9999 {card:C4} \\a", "{card:C4-} \\9999 \\a",
    "{phone:+9 (999) 999-9999} \\a \\9999", "{ip:B.B.B.B} {phone:+9 (999) 999-9999} {card:C4}", "\\a {ip:B.B.B.B} {email:a@a.a.T}", "{card:C4} {card:C4} \\a", "{phone:+9 (999) 999-9999} {phone:+9 (999) 999-9999} \\a", "\\a {email:a99@a9.a.T} {phone:+9 (999) 999-9999}.",
    # nothing personal
    "\\a \\a at \\a dot on \\a", "\\a at the dot and \\a", "the \\a at \\a dot \\a", "\\a at \\a dot is \\a", "invoice no \\999-\\999-\\9999 is \\a", "order no \\9999-\\999-\\9999", "\\a \\a at the dot", "\\a dot \\a at the \\a",
    "version \\99 . \\9 . \\9 . \\9 of \\a", "release \\9 . \\9 . \\9 . \\99 \\a", "build \\9 . \\99 . \\999 . \\9", "section \\9 . \\9 . \\9 . \\9", "chapter \\9 . \\9 . \\9", "version [\\9.\\9.\\9.\\9]",
    "order \\9999-\\999-\\9999 \\a", "order number \\999-\\999-\\9999", "invoice \\999-\\999-\\9999 \\a", "ticket \\9999-\\999-\\999", "case \\999-\\9999-\\999", "serial \\9999-\\9999-\\9999", "part \\999-\\999-\\9999", "tracking \\9999 \\9999 \\9999 \\9999",
    "ref \\999.\\999.\\9999", "account \\9999 \\9999 \\9999 \\9999", "code \\999-\\999-\\9999", "model \\999-\\9999 \\a", "reference \\9999 \\999 \\9999", "\\a at \\a. \\a", "\\a at \\a, \\a", "\\a \\a at \\a. \\a \\a", "arrived at \\a. then \\a",
    "\\a at \\a dot. \\a", "\\99 \\99 \\99 \\99", "\\9999 \\9999", "\\a \\99.\\99.\\99 \\a", "[\\9] \\a [\\9]", "\\a \\9, \\9, \\9, \\9 \\a", "\\a (\\9.\\9) \\a (\\9.\\9)",
    "order \\9999999999999999 was sent", "invoice number \\99999999", "version \\9.\\9.\\9 of \\a", "on \\9999-\\99-\\99 at \\99:\\99", "page \\99 of \\999", "\\a costs $ \\9,\\999.\\99 \\a", "id \\999999999999 \\a",
    "token = \" \\9999\\a\\99\\a \"", "\\a at \\a in \\a \\a", "look at the dot on \\a", "a dot at the \\a end", "\\a \\a \\a \\a \\a", "\\a \\9999 \\a \\999 \\a", "see http://\\a.\\a/\\999", "\\a, \\a \\9-\\9 \\a", "\\99 \\a \\99 \\a",
    "from \\9999 to \\9999", "\\a (\\9999) \\a, \\99-\\99", "isbn \\999-\\9-\\99-\\999999-\\9", "date \\99.\\99.\\9999 \\a", "\\99.\\99 \\a \\99 %", "meet at \\99 dot \\99", "\\a # \\99999 \\a", "\\a@\\a \\a", "\\9 \\9 \\9 \\9 \\9 \\a",
    "order \\999-\\9999999-\\9999999", "\\a \\9999.\\9999.\\9999 \\a", "\\a at \\a dot", "the dot \\a at \\a", "\\a at \\a \\a dot \\a \\a", "zip \\99999-\\9999 \\a", "\\999.\\9 \\a \\999.\\9", "\\a \\9999999999999999 \\a", "\\a \\999999999 \\a",
]
TOPLEVEL = ("com", "org", "net", "edu", "example", "de", "fr", "es", "io")


def _filled(pattern: str, rng: random.Random) -> str:
    def word() -> str:
        w = "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "ou", "ver", "sch", "ción", "que", "aux", "ment", "do")) for _ in range(rng.randint(1, 4)))
        return rng.choice((w, w, w, w.title(), w.upper()))

    if pattern.startswith("C4"):
        body = [rng.randint(0, 9) for _ in range(15)]
        digits = "".join(map(str, body))
        digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
        return pattern[2:].join(digits[i : i + 4] for i in range(0, 16, 4))
    out = ""
    for c in re.findall(r"[a-zA-Z]+|.", pattern):
        out += word() if c == "a" else str(rng.randint(0, 9)) if c == "9" else str(rng.randint(0, 255)) if c == "B" else rng.choice(TOPLEVEL) if c == "T" else c
    return out


def training_rows(times: int = 12, seed: int = 3) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]), each sentence of TRAINING filled so many times, each third time within prose."""
    rng, rows = random.Random(seed), []

    def prose() -> str:
        return " ".join("\\a" + rng.choice(("", "", "", "", ",", ".")) for _ in range(rng.randint(0, 30)))

    for k, sentence in enumerate(TRAINING * times):
        if k // len(TRAINING) % 3 == 2:
            sentence = f"{prose()} {sentence} {prose()}".strip()
        text, marks = "", []
        for part in re.split(r"(\{\w+:[^}]*\}|\\a|\\9+)", sentence):
            if part.startswith("{"):
                kind, _, pattern = part[1:-1].partition(":")
                value = _filled(pattern, rng)
                marks.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += _filled(part[1:], rng) if part.startswith("\\") else part
        rows.append((text, marks))
    return rows


def edged(values: np.ndarray) -> np.ndarray:
    """Values with CONTEXT empty ones on either side, as the field takes them; a part of a line keeps its neighbours there."""
    return np.pad(values, CONTEXT)


def _padded(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature values of each token and its neighbours (rows, length, offsets), and the mask."""
    most = max(map(len, values)) - 2 * CONTEXT
    x = np.zeros((len(values), most + 2 * CONTEXT), np.int64)
    mask = np.zeros((len(values), most), bool)
    for i, v in enumerate(values):
        x[i, : len(v)] = v
        mask[i, : len(v) - 2 * CONTEXT] = True
    return np.stack([x[:, o : o + most] for o in range(2 * CONTEXT + 1)], 2), mask


class Field:
    """Weights of (offset, value, label) and of (label, label)."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.state = np.zeros((2 * CONTEXT + 1, N_VALUES, n))
        self.step = np.zeros((n, n))
        self.barred = np.zeros((n, n))  # an inside label follows its own begin or inside only
        for j, label in enumerate(LABELS):
            if label[0] == "I":
                self.barred[[i for i, before in enumerate(LABELS) if before[1:] != label[1:]], j] = -1e4
        self.first = np.array([-1e4 if label[0] == "I" else 0.0 for label in LABELS])

    def emission(self, x: np.ndarray) -> np.ndarray:
        return sum(self.state[o][x[:, :, o]] for o in range(x.shape[2]))

    def fit(self, values: list[np.ndarray], labels: list[np.ndarray], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Field:
        """Gradient ascent on the log-likelihood of all rows, in groups of like length."""
        n = len(LABELS)
        order = np.argsort([len(v) for v in values], kind="stable")
        groups = []
        for part in np.array_split(order, min(8, len(order))):
            x, mask = _padded([values[i] for i in part])
            y = np.zeros(mask.shape, np.int64)
            for row, i in enumerate(part):
                y[row, : len(labels[i])] = labels[i]
            groups.append((x, mask, mask[:, 1:], [x[:, :, o][mask] for o in range(x.shape[2])], y))
        seen_state, seen_step = np.zeros_like(self.state), np.zeros_like(self.step)
        for _, mask, both, seen, y in groups:
            for o, v in enumerate(seen):
                np.add.at(seen_state[o], (v, y[mask]), 1)
            np.add.at(seen_step, (y[:, :-1][both], y[:, 1:][both]), 1)
        squares = [np.zeros_like(self.state), np.zeros_like(self.step)]
        for _ in range(rounds):
            expected, steps = np.zeros_like(self.state), np.zeros_like(self.step)
            for x, mask, both, seen, _ in groups:
                node, pair = self._marginals(x, mask, both)
                steps += pair
                for o, v in enumerate(seen):
                    for k in range(n):
                        expected[o][:, k] += np.bincount(v, node[:, k], N_VALUES)
            for w, g, q in ((self.state, (seen_state - expected) / len(values) - decay * self.state, squares[0]), (self.step, (seen_step - steps) / len(values) - decay * self.step, squares[1])):
                q += g * g
                w += rate * g / (np.sqrt(q) + 1e-6)
        return self

    def _marginals(self, x: np.ndarray, mask: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels of each token, and sums of those of label pairs, by forward and backward products."""
        rows, most, _ = x.shape
        e, t = self.emission(x), np.exp(self.step + self.barred)
        top = e.max(axis=2, keepdims=True)
        w = np.exp(e - top)  # scaled in each place, which the normalised products below don't feel
        forward, back = np.zeros_like(w), np.ones_like(w)
        forward[:, 0] = w[:, 0] * np.exp(self.first)
        forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
        for k in range(1, most):
            now = (forward[:, k - 1] @ t) * w[:, k]
            now /= now.sum(axis=1, keepdims=True)
            forward[:, k] = np.where(mask[:, k, None], now, forward[:, k - 1])
        for k in range(most - 2, -1, -1):
            now = (back[:, k + 1] * w[:, k + 1]) @ t.T
            now /= now.sum(axis=1, keepdims=True)
            back[:, k] = np.where(mask[:, k + 1, None], now, 1)
        node = forward * back
        node = (node / node.sum(axis=2, keepdims=True))[mask]
        left, right = forward[:, :-1][both], (back * w)[:, 1:][both]
        total = ((left @ t) * right).sum(axis=1, keepdims=True)
        return node, t * ((left / total).T @ right)

    def decode(self, values: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence, by Viterbi over all of them at a time."""
        x, mask = _padded(values)
        e, t = self.emission(x), self.step + self.barred
        rows, most, n = e.shape
        best, come = e[:, 0] + self.first, np.zeros((rows, most, n), np.int64)
        for k in range(1, most):
            way = best[:, :, None] + t
            come[:, k] = np.where(mask[:, k, None], way.argmax(1), np.arange(n))
            best = np.where(mask[:, k, None], way.max(1) + e[:, k], best)
        out = np.zeros((rows, most), np.int64)
        out[:, -1] = best.argmax(1)
        for k in range(most - 1, 0, -1):
            out[:, k - 1] = come[np.arange(rows), k, out[:, k]]
        return [out[i, : len(v) - 2 * CONTEXT] for i, v in enumerate(values)]


@lru_cache(maxsize=1)
def field() -> Field:
    values, labels = [], []
    for text, marks in training_rows():
        spans, v = tokens(text)
        y = np.zeros(len(spans), np.int64)
        for s, e, kind in marks:
            for i, (a, b) in enumerate(spans):
                if s <= a and b <= e:
                    y[i] = LABELS.index(("B-" if a == s else "I-") + kind)
        values.append(edged(v))
        labels.append(y)
    return Field().fit(values, labels)


#: An address written out: words joined by at and dot, as words, signs or in brackets.
_JOIN = r"\s*(?:[\[({]\s*%s\s*[\])}]|%s)\s*"
_WRITTEN = re.compile(r"(?i)[\w%+-]+(?:DOT[\w%+-]+)*AT[\w-]+(?:DOT[\w-]+)+".replace("DOT", _JOIN % (r"(?:dot|\.)", r"(?:\bdot\b|\.)")).replace("AT", _JOIN % ("(?:at|@)", r"(?:\bat\b|@)")))


def _holds(kind: str, text: str) -> bool:
    """What a span must hold that the field adds."""
    if kind == "email":
        return bool(_WRITTEN.fullmatch(text))
    digits = re.findall("[0-9]+", text)
    if kind == "ip":
        return len(digits) == 4 and all(len(d) <= 3 and int(d) <= 255 for d in digits)
    return _card(text) if kind == "card" else _phone(text) and len(digits) > 1


_TRIGGER = re.compile(r"[0-9@]|\b[dD][oO][tT]\b|[\[({][aA][tT]|\b[aA][tT][ \t]+[\w-]+\.[^\W\d_]")

_AT = re.compile(rb"(?i)\bat[ \t]+[^\s.]+\.[A-Za-z\x80-\xFF]")


def _islands(text: str) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """Token sequences round what a span needs; a sequence ends at a line end."""
    out, line = [], 0
    for line_end in (*(m.start() for m in re.finditer("\n", text)), len(text)):
        if _TRIGGER.search(text, line, line_end):
            spans, v = tokens(text, line, line_end)
            hot = np.array([bool(_TRIGGER.match(text, a)) for a, b in spans])
            near = np.flatnonzero(np.convolve(hot, np.ones(2 * WINDOW + 1), "same" if len(hot) > 2 * WINDOW else "full") > 0) if len(hot) > 2 * WINDOW else np.arange(len(hot))
            for part in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
                if len(part):
                    out.append((spans[part[0] : part[-1] + 1], edged(v)[part[0] : part[-1] + 1 + 2 * CONTEXT]))
        line = line_end + 1
    return out


def added_spans(texts: list[str], base: list[dict[str, list[tuple[int, int]]]], model: Field, batch: int = 512) -> list[dict[str, list[tuple[int, int]]]]:
    """What the field finds in each text beside the base spans."""
    out = [{k: [] for k in KINDS} for _ in texts]
    work = [(i, spans, v) for i, text in enumerate(texts) for spans, v in _islands(text)]
    work.sort(key=lambda x: len(x[2]))  # alike lengths share a batch
    at = 0
    while at < len(work):
        part = work[at : at + max(1, min(batch, 200_000 // max(1, len(work[min(at + batch, len(work)) - 1][2]))))]
        at += len(part)
        for (i, spans, _), labels in zip(part, model.decode([x[2] for x in part]), strict=True):
            k = 0
            while k < len(labels):
                if LABELS[labels[k]][0] == "B":
                    kind, first = LABELS[labels[k]][2:], k
                    while k + 1 < len(labels) and LABELS[labels[k + 1]] == f"I-{kind}":
                        k += 1
                    s, e = spans[first][0], spans[k][1]
                    if _holds(kind, texts[i][s:e]) and not any(s < y and x < e for found in base[i].values() for x, y in found):
                        out[i][kind].append((s, e))
                k += 1
    return out


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    model = docs.sparkSession.sparkContext.broadcast(field())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    none = hashlib.sha256(b"").hexdigest()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit = np.zeros(256, bool)
        digit[[64, *range(48, 58)]] = True
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in chunks(off):
                own, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                low = own | 32
                hit = digit[own]
                hit[:-2] |= (low[:-2] == 100) & (low[1:-1] == 111) & (low[2:] == 116)
                hit[:-2] |= ((own[:-2] == 40) | (low[:-2] == 123)) & (low[1:-1] == 97) & (low[2:] == 116)
                marked = np.diff(np.concatenate([[0], np.cumsum(hit)])[at]) > 0
                word = np.flatnonzero((low[:-2] == 97) & (low[1:-1] == 116) & ((own[2:] == 32) | (own[2:] == 9)))  # at: only before a dotted name
                for i in np.unique(np.searchsorted(at, word, "right") - 1):
                    marked[i] = marked[i] or _AT.search(own[at[i] : at[i + 1]].tobytes()) is not None
                marked = np.flatnonzero(marked)
                texts = [own[at[i] : at[i + 1]].tobytes().decode() for i in marked]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model.value)
                counts = np.zeros((len(KINDS), b - a), np.int64)
                digest, spans = [none] * (b - a), [""] * (b - a)
                for i, x, y in zip(marked, base, more, strict=True):
                    counts[:, i] = [len(x[k]) for k in KINDS]
                    digest[i] = hashlib.sha256(listed(x).encode()).hexdigest()
                    spans[i] = listed({k: x[k] + y[k] for k in KINDS})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans)], names)

    names = ["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("_id", id_col)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
