"""Personal data by patterns and a skip-chain conditional random field.

Base spans are pattern matches with checks. The field labels the tokens that can be personal data
(digits, an at sign, or a local part of an address that stands alone). Unary potentials come from the
base spans, the token's shape, and the cue words before it, for an entity or for something else (an
order, a book, a date); a linear chain joins neighbouring
candidates; and a skip edge joins each occurrence of a token to its next occurrence, or to the next
token with the same significant characters, however far away. Max-product messages are passed over
this graph, both ways along every edge, until they settle; tokens that end with an entity label and
lie in no base span become added spans of that kind. Edges join consecutive occurrences only, so a
token that repeats n times makes at most 2 (n - 1) of them.

The field is run on every text that has a candidate, with or without base spans and edges.

The potentials are trained, by an averaged structured perceptron over texts made from a seed: mentions
in base form, later mentions in other forms, and numbers that are nothing; and as many texts without a
base span, where a cue word tells one mention and edges tell the others, or where nothing is to be found.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, map_arrow, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
ROUNDS = 1000  # of message passing, at most; damped messages settle long before
SETTLED = 1e-3
DAMPING = 0.3

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # starts of digit runs only: no other start can match
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_MARKS = ".,;:!?\"'()[]<>{}"
_OCTETS = re.compile(r"([0-9]{1,3})([.-])([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})")
_DATE = re.compile(r"(?:1[0-9]|20)[0-9]{2}([./-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([./-])[01]?[0-9]\2(?:1[0-9]|20)[0-9]{2}|(?:19|20)[0-9]{6}(?:[0-9]{6})?")
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_CUES = {"email": ("email", "e-mail", "mail", "mailto", "user", "username", "login"), "ip": ("ip", "host", "server", "address", "addr"), "card": ("card", "visa", "mastercard", "amex", "credit", "payment"), "phone": ("phone", "tel", "telephone", "mobile", "cell", "call", "fax", "whatsapp")}
# Words before numbers that are no personal data.
_OTHER = ("isbn", "issn", "order", "invoice", "sku", "id", "version", "date", "year", "page", "ticket", "case", "serial", "part", "lot", "batch", "build", "row", "item", "code", "ref", "reference", "doi", "pmid", "version", "release", "since", "until", "on", "in")
_NEAR = 3  # words before a token that are looked at; the nearest cue counts
_CUE = {w: 0 for w in _OTHER} | {w: i + 1 for i, k in enumerate(KINDS) for w in _CUES[k]}

# What the potentials are of. The first seven are of a token and a label, the others of an edge between
# two tokens of one entity label; those are never negative.
FEATURES = ("no entity", "in a base span of the label", "shape suits", "shape does not suit", "cue word before", "no base span or cue among the linked", "cue word of something else before", "same token", "same characters", "neighbours")
_UNARY = 7
TRAIN_TEXTS, EPOCHS, SEED = 300, 4, 9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches around each at sign; each looks back over its own local part only."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind from 0) by start, then kind."""
    spans = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def _shape(word: str) -> tuple[bool, bool, bool, bool]:
    """Which entity labels a token's shape suits."""
    word = word.strip(_MARKS)
    n = sum("0" <= c <= "9" for c in word)
    plain = len(word) - n
    m = _OCTETS.fullmatch(word)
    octets = bool(m) and all(int(x) <= 255 for x in m.group(1, 3, 4, 5))
    digits = "".join(c for c in word if "0" <= c <= "9")
    return (
        "@" in word or (n <= 4 and plain >= 4 and word[:1].isalpha()),
        octets,
        12 <= n <= 19 and plain <= 4 and not octets and luhn(digits),
        7 <= n <= 15 and (plain > 0 or n >= 9) and not any(c.isalpha() for c in word) and not m and not _DATE.fullmatch(word),
    )


def _key(word: str) -> tuple[str, str]:
    """The token without outer marks, and its significant characters (digits, or letters folded)."""
    core = word.strip(_MARKS)
    digits = "".join(c for c in core if "0" <= c <= "9")
    return core.lower(), digits if len(digits) >= 7 else ""


def infer(unary: np.ndarray, edges: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Max-product messages over edges that reward equal entity labels; returns each node's label."""
    n, k = unary.shape
    m = len(edges)
    if not m:
        return unary.argmax(axis=1)
    a, b = edges.T
    ends, starts = np.concatenate([b, a]), np.concatenate([a, b])
    bonus = np.concatenate([gain, gain])[:, None]
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    messages = np.zeros((2 * m, k))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, ends, messages)
        out = belief[starts] - messages[back]
        best = out.max(axis=1, keepdims=True)
        new = np.maximum(best, out + np.concatenate([np.zeros((2 * m, 1)), np.repeat(bonus, k - 1, axis=1)], axis=1))
        new -= new.max(axis=1, keepdims=True)
        new = DAMPING * messages + (1 - DAMPING) * new
        done = np.abs(new - messages).max() < SETTLED
        messages = new
        if done:
            break
    belief = unary.copy()
    np.add.at(belief, ends, messages)
    return belief.argmax(axis=1)


def graph(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate spans, their features (token x label x feature), whether each lies in a base span, edges and their kinds."""
    at = [m.span() for m in _CANDIDATE.finditer(text)]
    names = {text[a : text.index("@", a)].lower() for a, _, kind in base if kind == 0}
    seen = set(at)
    for local in sorted(names):
        # A local part may stand alone without a digit: those words join in.
        if len(local) >= 5 and not any("0" <= c <= "9" for c in local):
            for m in re.finditer(rf"(?<![^\x20\x09-\x0D\"'(<\[]){re.escape(local)}(?=[\x20\x09-\x0D.,;:!?\"')>\]]|\Z)", text, re.I):
                seen.add(m.span())
    # A base span is one candidate, whatever tokens it has; overlapping ones are one.
    whole: list[tuple[int, int]] = []
    for a, b, _ in base:
        if whole and a < whole[-1][1]:
            whole[-1] = (whole[-1][0], max(b, whole[-1][1]))
        else:
            whole.append((a, b))
    j, rest = 0, []
    for a, b in sorted(seen):
        while j < len(whole) and whole[j][1] <= a:
            j += 1
        if j == len(whole) or whole[j][0] >= b:
            rest.append((a, b))
    at = sorted(whole + rest)
    n = len(at)
    words = [text[a:b] for a, b in at]
    f = np.zeros((n, len(LABELS), _UNARY))
    f[:, 0, 0] = 1
    inside = np.zeros(n, bool)
    j = 0
    for i, (a, b) in enumerate(at):
        suits = _shape(words[i])
        f[i, 1:, 2] = suits
        f[i, 1:, 3] = ~np.array(suits)
        while j < len(base) and base[j][1] <= a:
            j += 1
        k = j
        while k < len(base) and base[k][0] < b:
            if base[k][1] > a:
                f[i, 1 + base[k][2], 1] = 1
                inside[i] = True
            k += 1
        lead = _LEAD.findall(text, max(0, a - 40, at[i - 1][1] if i else 0), a)
        for word in lead[: -_NEAR - 1 : -1]:
            label = _CUE.get(word.lower())
            if label is not None:
                f[i, label or slice(1, None), 4 if label else 6] = 1
                break
    edges, kinds = [], []
    last: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for i, w in enumerate(words):
        core, digits = _key(w)
        same = {core, core.partition("@")[0]} if "@" in core else {core}
        linked: set[int] = set()
        for kind, found in ((0, [x for x in sorted(same) if len(x) >= 5]), (1, [digits] if digits else [])):
            for key in found:
                before = last[kind].get(key)
                if before is not None and before not in linked:
                    edges.append((before, i))
                    kinds.append(kind)
                    linked.add(before)
                last[kind][key] = i
        # A base span is whole, and a mark ends what came before: neither goes on in its neighbour.
        if i and at[i][0] - at[i - 1][1] <= 1 and i - 1 not in linked and not inside[i - 1] and not inside[i] and words[i - 1][-1] not in ",;.:!?":
            edges.append((i - 1, i))
            kinds.append(2)
    # Links alone make no entity: one token of those that edges join has to be a base span or follow a cue.
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        root[top(a)] = top(b)
    told = {top(i) for i in np.flatnonzero(inside | (f[:, :, 4] > 0).any(axis=1)).tolist()}
    f[:, 1:, 5] = np.array([top(i) not in told for i in range(n)], bool).reshape(n, 1)
    return at, f, inside, np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64)


_LEAD = re.compile(r"[A-Za-z-]+")


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field labels beside the base spans."""
    at, f, inside, edges, kinds = graph(text, base)
    if inside.all():  # or there is no candidate
        return []
    label = infer(f @ weights[:_UNARY], edges, weights[_UNARY:][kinds])
    out = []
    for i in np.flatnonzero((label > 0) & ~inside).tolist():
        a, b = at[i]
        core = text[a:b].strip(_MARKS)
        if core:
            lead = text[a:b].index(core)
            out.append((a + lead, a + lead + len(core), int(label[i]) - 1))
    return out


# ---------------------------------------------------------------- training


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made text and its true mentions."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    parts: list[tuple[str, int]] = []  # (text, kind or -1)
    for _ in range(rng.randint(1, 3)):
        kind = rng.randrange(4)
        if kind == 0:
            local = f"{word()}{word()}" + rng.choice(["", ".", digits(2)])
            local = local.rstrip(".")
            forms = [f"{local}@{word()}.org", local]
        elif kind == 1:
            forms = [".".join(str(rng.randint(0, 255)) for _ in range(4))]
            forms.append(forms[0].replace(".", "-"))
        elif kind == 2:
            body = "4" + digits(14)
            number = next(body + c for c in "0123456789" if luhn(body + c))
            forms = [number, ".".join(number[i : i + 4] for i in range(0, 16, 4))]
        else:
            number = "1" + digits(10)
            forms = [f"+{number[0]} ({number[1:4]}) {number[4:7]}-{number[7:]}", rng.choice([number, f"{number[:4]}-{number[4:]}"])]
        cue = rng.choice(["", "", rng.choice(_CUES[KINDS[kind]]) + " "])
        for form in [forms[0]] + [rng.choice(forms) for _ in range(rng.randint(0, 3))]:
            parts.append((cue + "\0" + form, kind))
    for _ in range(rng.randint(1, 6)):
        n = rng.choice([digits(rng.randint(1, 6)), f"{digits(2)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{word()}{digits(3)}", digits(rng.randint(7, 16))])
        lead = rng.choice(["", rng.choice(_OTHER) + " "])
        parts += [(lead + "\0" + n, -1)] * rng.randint(1, 3)
    rng.shuffle(parts)
    # The base form of a mention comes before its others often enough; order is not asked for.
    text, spans = "", []
    for piece, kind in parts:
        text += "".join(word() + " " for _ in range(rng.choice((0, 1, 2, 3, 4, 6))))
        lead, _, form = piece.partition("\0")
        text += lead
        if kind >= 0:
            spans.append((len(text), len(text) + len(form), kind))
        text += form + rng.choice([" ", ", ", ". "])
    return text, spans


def bare_example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made text without a base span, and its true mentions: one after a cue word, others like it."""
    while True:
        digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
        parts: list[tuple[str, str, int]] = []  # (lead, text, kind or -1)
        for _ in range(rng.randint(0, 2)):
            kind = rng.randrange(4)
            body = "4" + digits(14)
            number = next(body + c for c in "0123456789" if luhn(body + c))
            if kind == 0:
                forms = [f"{word()}{word()}{digits(2)}"]
            elif kind == 1:
                forms = ["-".join(str(rng.randint(0, 255)) for _ in range(4))]
            elif kind == 2:
                forms = [sign.join(number[i : i + 4] for i in range(0, 16, 4)) for sign in "./"]
            else:
                number = number[:10]
                forms = [number, f"{number[:3]}-{number[3:6]}-{number[6:]}", f"{number[:3]}.{number[3:6]}.{number[6:]}"]
            for i in range(rng.randint(1, 4)):
                cue = rng.choice(_CUES[KINDS[kind]]) + rng.choice([" ", ": ", " number ", " is "]) if i == 0 or rng.random() < 0.3 else ""
                parts.append((cue, rng.choice(forms), kind))
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([digits(rng.randint(1, 6)), f"{digits(2)}.{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{word()}{digits(3)}", digits(rng.randint(7, 16))])
            lead = rng.choice(["", rng.choice(_OTHER) + " "])
            parts += [(lead, n, -1)] * rng.choice((1, 1, 2, 3, 8))
        for _ in range(rng.randint(0, 2)):  # a cue before what is too short, and a row of numbers
            parts.append((rng.choice(_CUES[rng.choice(KINDS)]) + " ", rng.choice([digits(rng.randint(1, 5)), f"20{digits(2)}-0{digits(1)}-1{digits(1)}"]), -1))
            parts.append(("", " ".join(digits(rng.randint(1, 4)) for _ in range(rng.randint(2, 8))), -1))
        rng.shuffle(parts)
        text, spans = "", []
        for lead, form, kind in parts:
            text += "".join(word() + " " for _ in range(rng.choice((0, 1, 2, 3, 4, 6)))) + lead
            if kind >= 0:
                spans.append((len(text), len(text) + len(form), kind))
            text += form + rng.choice([" ", ", ", ". "])
        if not base_spans(text):
            return text, spans


@lru_cache(1)
def potentials() -> tuple[float, ...]:
    """Weights of FEATURES, trained on TRAIN_TEXTS made texts of each sort; the same in every run."""
    rng = random.Random(SEED)
    made = []
    for make in (example, bare_example) * TRAIN_TEXTS:
        text, true = make(rng)
        at, f, _, edges, kinds = graph(text, base_spans(text))
        gold = np.zeros(len(at), np.int64)
        for i, (a, b) in enumerate(at):
            gold[i] = next((k + 1 for s, e, k in true if s < b and e > a), 0)
        made.append((f, edges, kinds, gold))

    def total(f: np.ndarray, edges: np.ndarray, kinds: np.ndarray, label: np.ndarray) -> np.ndarray:
        alike = (label[edges[:, 0]] == label[edges[:, 1]]) & (label[edges[:, 0]] > 0)
        return np.concatenate([f[np.arange(len(label)), label].sum(axis=0), np.bincount(kinds[alike], minlength=len(FEATURES) - _UNARY)])

    weights, mean = np.concatenate([np.ones(_UNARY), np.ones(len(FEATURES) - _UNARY)]), np.zeros(len(FEATURES))
    weights[3] = weights[5] = -1.0
    for _ in range(EPOCHS):
        rng.shuffle(made)
        for f, edges, kinds, gold in made:
            label = infer(f @ weights[:_UNARY], edges, weights[_UNARY:][kinds])
            if (label != gold).any():
                weights = weights + 0.1 * (total(f, edges, kinds, gold) - total(f, edges, kinds, label))
                weights[_UNARY:] = np.maximum(weights[_UNARY:], 0)
            mean += weights
    return tuple(np.round(mean / (EPOCHS * len(made)), 6).tolist())


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(text: str, weights: np.ndarray | None = None) -> tuple:
    base = base_spans(text)
    counts = [sum(k == i for _, _, k in base) for i in range(4)]
    extra = added_spans(text, base, np.array(potentials()) if weights is None else weights)
    every = sorted({*base, *extra}, key=lambda s: (s[0], s[2], s[1]))
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(extra), len(every))


_OUT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())])
_NOTHING = scan("")


_SIGN = re.compile(r"[0-9@]")


def _scanner(weights: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for rows in batches:
            found = [scan(t, w) if _SIGN.search(t) else _NOTHING for t in texts(rows.column("text"))]
            columns = [list(c) for c in zip(*found, strict=True)] or [[]] * 8
            yield batch(_OUT, doc_id=rows.column("doc_id"), **dict(zip(_OUT.names[1:], columns, strict=True)))

    return run


def pii_spans(docs: DataFrame) -> DataFrame:
    """Personal data of every row of ``docs`` (doc_id, text), found over the whole text.

    n_email, n_ip, n_card, n_phone count base spans; base_sha256 digests them; spans lists base and
    added ones; n_added and n_spans count the added and all. A null or empty text has none (the digest of the empty string); a null doc_id is
    passed on; repeated rows come back repeated; no rows, no rows.
    """
    return map_arrow(docs.select("doc_id", "text"), _scanner(potentials()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
