"""Personal data: exact base patterns, and a semi-Markov CRF that adds spans.

The base kinds (email, ip, card, phone) are found by their patterns, leftmost and
not overlapping per kind, in linear time. The semi-Markov conditional random field
adds ``secret``, ``iban`` and ``ssn`` spans: a candidate segment of at most
``MAX_TOKENS`` tokens is scored by features of the whole span (shape, alphabet, length,
digit share, variety, known heads), of the words and marks around it, and by the labels
of neighbouring segments (transition weights); dynamic programming over the tokens
chooses boundaries and types jointly. The bound on an entity is in tokens alone: a run of
word characters is one token however long it is, so no secret is too long. What follows a
telling name and a mark of assignment (``password =``) is one token too, whatever marks
it has and however short it is: up to the closing quote, or else up to white space. So is
a private key in PEM form, from its first mark to its last.

Only neighbourhoods of *cores* are decoded, elsewhere "outside" is the only label: such
values and keys, runs of at least ``MIN_CORE`` word characters with a digit or several
changes from lower to upper case, and groups as spaced IBANs have; segments with blanks
are candidates in that form alone. Letters in one case with no telling name before them
look like any word and aren't candidates, nor are shorter runs without one.

The weights are trained here, by stochastic gradient on the log-likelihood
(forward-backward over segments and labels), on sentences generated by rule from
invented values; the training set and so the model are fixed and small. Digests, commit
ids and UUIDs count as secrets only where a name says so.

Base spans stay as they are. An added span may hold whole base spans (a long secret has
digits that pass for a card); one that a base span equals, covers or cuts is dropped.
Defined results: a null text is empty and has no spans; every row is kept, repeated
rows too; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm._work import tidy

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "ssn")
KINDS = BASE + ADDED
MAX_TOKENS = 9
MIN_CORE = 8
#: Characters around a core whose tokens are decoded with it.
AROUND = 48

Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        found = _DOMAIN.match(text, at + 1) if lo < at else None
        if found:
            free = found.end()
            yield "email", lo, free
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds in order of start, then kind."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 or len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# ---- semi-Markov CRF -------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9]+(?:[_+/-]+[A-Za-z0-9]+)*|[^\sA-Za-z0-9]")
_SPACED = re.compile(r"\b[A-Z]{2}[0-9]{2} [0-9A-Z]{4} [0-9A-Z]{2}")
_WITH_DIGIT = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+")
_LETTERS = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z_+/-]{16,}+(?![0-9])")
_TURN = re.compile(r"[a-z][A-Z]")
_MARKS = re.compile(r"[^\sA-Za-z0-9_+/.-]+")
_WORDY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
_SYMBOLS, _DIGITS, _UPPER, _LOWER = (re.compile(x) for x in (r"[^A-Za-z0-9]+", r"[0-9]+", r"[A-Z]+", r"[a-z]+"))
_SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "key", "pass", "kennwort", "bearer", "credential", "authorization")
_CUES = (*_SECRET_CUES, "iban", "ssn", "account", "social", "security")
_OTHER_CUES = ("commit", "sha", "md5", "checksum", "digest", "uuid", "hash", "etag", "revision", "blob", "order", "ref", "id")
_ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwort|kennwort|passphrase|passcode|pwd|key|credentials?)[\"']?[ \t]{0,3}(?:[:=]{1,2}|=>)[ \t]{0,3}([\"']?)")
_UNQUOTED = re.compile(r"(?:(?![&;,][\w.-]{1,40}[:=])\S)+")
_PEM = re.compile(r"-----(BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----")
_GROUPS = re.compile(r"[A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4})*(?: [0-9A-Z]{1,4})")
_HEADS = ("AKI", "ASI", "ghp", "gho", "xox", "eyJ", "sk_", "sk-", "pk_", "AIz")  # fixed values: heads of well-known keys
OUTSIDE = "outside"
LABELS = (OUTSIDE, *ADDED)


def _shape(s: str) -> str:
    out = _LOWER.sub("a", _UPPER.sub("A", _DIGITS.sub("9", s)))
    return out if len(out) <= 5 else "mixed" + "".join(sorted(set(out)))


def values(text: str) -> list[tuple[int, int]]:
    """Assigned values and private keys, in order and apart from each other; in linear time."""
    keys, begin = [], -1
    for m in _PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        if m.group(1) == "BEGIN":
            begin = m.start()
        elif begin >= 0:
            keys.append((begin, m.end()))
            begin = -1
    out, at, low = keys, 0, text.lower()
    if any(c in low for c in _SECRET_CUES):
        out, k = [], 0
        while m := _ASSIGNED.search(text, at):
            a = at = m.end()
            while k < len(keys) and keys[k][1] <= a:
                k += 1
            if k < len(keys) and keys[k][0] < a:
                continue
            line = text.find("\n", a) if m.group(1) else -1
            b = text.find(m.group(1), a, line if line >= 0 else len(text)) if m.group(1) else -1
            if b < 0:
                b = a + len((found.group() if (found := _UNQUOTED.match(text, a)) else "").rstrip(".,;:)]}>\"'"))
            b = min(b, keys[k][0]) if k < len(keys) else b
            if a < b and text[a:b].strip():
                out.append((a, b))
                at = b
        out = sorted(out + keys)
    return out


def tokenize(text: str, lo: int = 0, hi: int | None = None, whole: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Tokens between two places, with each value in ``whole`` as one."""
    hi = len(text) if hi is None else hi
    out: list[tuple[int, int]] = []
    for a, b in (*(values(text) if whole is None else whole), (hi, hi)):
        out += [(x + lo, y + lo) for x, y in (m.span() for m in _TOKEN.finditer(text[lo:a]))]
        if a < b:
            out.append((a, b))
        lo = b
    return out


def surroundings(text: str, tokens: list[tuple[int, int]], i: int) -> tuple[str, bool, bool, str]:
    """The cue before token i, whether it is right before it, another name, and the marks between."""
    before = [text[a : min(b, a + 24)].lower() for a, b in tokens[max(0, i - 5) : i]]
    marks = ""
    while before and not before[-1][0].isalnum() and len(marks) < 3:
        marks = before.pop()[0] + marks
    words = [w for w in before if w[0].isalnum()][-3:]
    cue = next((w for w in reversed(words) for c in _CUES if c in w), "")
    told = next((c for c in _CUES if cue and c in cue), "")
    close = bool(words) and any(c in words[-1] for c in _CUES)
    return told, close, bool(words) and any(c in words[-1] for c in _OTHER_CUES) and not close, marks


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int, about: tuple[str, bool, bool, str], value: bool) -> list[str]:
    """Features of the segment of tokens i..j-1 as a whole, and of its surroundings."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s = text[a:b]
    solid = _SYMBOLS.sub("", s)
    n = len(solid)
    digits = n - len(_DIGITS.sub("", solid))
    kinds = set(solid)
    if not n:
        alphabet = "marks"
    elif kinds <= frozenset("0123456789abcdef"):
        alphabet = "digits" if digits == n else "hex"
    elif kinds <= frozenset("0123456789ABCDEF"):
        alphabet = "HEX"
    elif kinds <= frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        alphabet = "upper" if digits else "UPPER"
    else:
        alphabet = ("lower" if digits else "letters") if solid == solid.lower() else "mixed" if digits else "Letters"
    told, close, other, marks = about
    assigned = close and marks[:1] in ("=", ":")
    groups = s.replace("-", " ").replace(".", " ").split()
    head = "PEM" if s.startswith("-----BEGIN") else s[:3] if s[:3] in _HEADS else ""
    goes_on = text[b : b + 1] in (".", "-") and text[b + 1 : b + 2].isalnum() or a > 1 and text[a - 1] in ".-" and text[a - 2].isalnum()
    size = min(n, 48) // 4
    inner = sum(map(len, _MARKS.findall(s))) if value and len(s) < 200 else 0
    return [
        "bias",
        f"shape {_shape(s)}",
        f"alphabet {alphabet}",
        f"length {size}",
        f"alphabet and length {alphabet} {size}",
        f"digits {round(4 * digits / max(1, n))}" if alphabet not in ("hex", "HEX") else "digits hex",
        f"variety {min(5, len(kinds) // 4)}",
        f"tokens {j - i}",
        f"groups {min(9, len(groups))} {min(9, len(groups[0])) if len(groups) > 1 else 0}",
        f"start {_shape(solid[:4]) if solid[:1].isupper() else ''} {alphabet}",
        f"head {head}",
        f"goes on {goes_on} {head}",
        f"cue {told}",
        f"cue and marks {close} {marks}",
        f"cue, marks and alphabet {close} {marks[:1]} {alphabet}",
        f"cue, assignment and alphabet {told} {assigned} {alphabet}",
        f"other cue {other} {alphabet}",
        f"value {value} {alphabet} {size} {told in ('key', 'token', 'secret')}",
        f"marks inside {min(inner, 3)} {alphabet} {value}",
        f"blanks {value} {' ' in s}",
    ]


class SemiCrf:
    """Weights by (label, feature); a token outside scores 0 but for the transition to it."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}
        self._rows: dict[str, list[float]] = {}
        self._rows_of: object = None

    @staticmethod
    def candidates(text: str, tokens: list[tuple[int, int]], whole: frozenset[tuple[int, int]] = frozenset()) -> list[tuple[int, int, list[str]]]:
        """Segments that may be entities, with their features; tokens in ``whole`` are assigned values."""
        out = []
        for i, (a, b) in enumerate(tokens):
            value = (a, b) in whole
            if not (value or text[a].isalnum()):
                continue
            about = None
            for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
                c, d = tokens[j - 1]
                gap = c - tokens[j - 2][1] if j - 1 > i else 0
                mark = not text[c].isalnum() and j > i + 1
                if gap > 1 or mark and (text[c] not in "-." or gap or j == len(tokens) or text[c] == "." and tokens[j][0] != d):
                    break
                if gap and not _GROUPS.fullmatch(text, a, d):
                    break
                if value and j == i + 1 or not mark and d - a >= MIN_CORE and (j == i + 1 or _DIGIT.search(text, a, d)):
                    about = about or surroundings(text, tokens, i)
                    out.append((i, j, span_features(text, tokens, i, j, about, value and j == i + 1)))
        return out

    def score(self, label: str, features: list[str]) -> float:
        w = self.weights
        return sum(w.get((label, f), 0.0) for f in features)

    def transitions(self) -> list[list[float]]:
        """Weights of label pairs, previous label first."""
        return [[self.weights.get((y, f"after {x}"), 0.0) for y in LABELS] for x in LABELS]

    def decode(self, text: str, tokens: list[tuple[int, int]], whole: frozenset[tuple[int, int]] = frozenset()) -> list[Span]:
        """The best segmentation and labels: entities among the tokens."""
        ending: dict[int, list] = {}
        if self._rows_of is not self.weights:
            names = {f for _, f in self.weights}
            self._rows = {f: [self.weights.get((y, f), 0.0) for y in ADDED] for f in names}
            self._rows_of = self.weights
        get, none = self._rows.get, [0.0] * len(ADDED)
        for i, j, features in self.candidates(text, tokens, whole):
            for y, s in enumerate(map(sum, zip(*(get(f, none) for f in features), strict=True)), 1):
                if s > -20:
                    ending.setdefault(j, []).append((i, y, s))
        if not ending:
            return []
        move = self.transitions()
        labels = range(len(LABELS))
        best = [[0.0] + [-math.inf] * len(ADDED)]
        back: list[list] = [[None] * len(LABELS)]
        for j in range(1, len(tokens) + 1):
            best.append([-math.inf] * len(LABELS))
            back.append([None] * len(LABELS))
            for i, y, s in ((j - 1, 0, 0.0), *ending.get(j, ())):
                x = max(labels, key=lambda x: best[i][x] + move[x][y])  # noqa: B023
                value = best[i][x] + move[x][y] + s
                if value > best[j][y]:
                    best[j][y], back[j][y] = value, (i, x)
        out, j = [], len(tokens)
        y = max(labels, key=best[j].__getitem__)
        while j:
            i, x = back[j][y]
            if y:
                out.append((LABELS[y], tokens[i][0], tokens[j - 1][1]))
            j, y = i, x
        return out[::-1]

    def train(self, examples: list[tuple[str, list[Span]]], rounds: int = 5, rate: float = 0.5) -> None:
        """Stochastic gradient (AdaGrad) on the log-likelihood of the segmentations."""
        squares: dict[tuple[str, str], float] = {}
        lattices = []
        for text, gold in examples:
            whole = values(text)
            tokens = tokenize(text, whole=whole)
            segments = self.candidates(text, tokens, frozenset(whole))
            wanted = {(a, b): LABELS.index(y) for y, a, b in gold}
            truth = [wanted.get((tokens[i][0], tokens[j - 1][1]), 0) for i, j, _ in segments]
            lattices.append((len(tokens), segments, truth))
        for _ in range(rounds):
            for n, segments, truth in lattices:
                gradient: dict[tuple[str, str], float] = {}
                scores = [[self.score(y, f) for y in ADDED] for _, _, f in segments]
                move = self.transitions()
                into, beyond, starts, total, forward = forward_backward(n, [(i, j) for i, j, _ in segments], scores, move)
                for (i, j, features), per, gold in zip(segments, scores, truth, strict=True):
                    for y, s in enumerate(per, 1):
                        gap = (y == gold) - math.exp(into[i][y] + s + beyond[j][y] - total)
                        if abs(gap) > 1e-4:
                            for f in features:
                                gradient[LABELS[y], f] = gradient.get((LABELS[y], f), 0.0) + gap
                path = {i: (j, y) for (i, j, _), y in zip(segments, truth, strict=True) if y}
                at, last = 0, 0
                while at < n:
                    at_next, y = path.get(at, (at + 1, 0))
                    for k in range(at, at_next):  # expected transitions at each place, true ones where a segment starts
                        for x in range(len(LABELS)):
                            for z in range(len(LABELS)):
                                if x or z:
                                    gap = (k == at and x == last and z == y) - math.exp(forward[k][x] + move[x][z] + starts[k][z] - total)
                                    if abs(gap) > 1e-4:
                                        key = LABELS[z], f"after {LABELS[x]}"
                                        gradient[key] = gradient.get(key, 0.0) + gap
                    at, last = at_next, y
                for k, g in gradient.items():
                    squares[k] = squares.get(k, 0.1) + g * g
                    self.weights[k] = 0.9999 * self.weights.get(k, 0.0) + rate * g / math.sqrt(squares[k])


def forward_backward(n: int, segments: list[tuple[int, int]], scores: list[list[float]], move: list[list[float]]) -> tuple:
    """Log sums over all segmentations: into a label at a place, beyond a label that ends there,
    of segments that start there, of everything, and of what ends there."""
    none = [-math.inf] * len(LABELS)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(segments):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    labels = range(len(LABELS))
    forward, into = [[0.0, *none[1:]]], []
    for j in range(n + 1):
        if j:
            ends = [[into[j - 1][0]], *([into[segments[k][0]][y] + scores[k][y - 1] for k in by_end.get(j, ())] for y in labels[1:])]
            forward.append([_logsum(e) for e in ends])
        into.append([_logsum([forward[j][x] + move[x][y] for x in labels]) for y in labels])
    beyond, starts = [none] * n + [[0.0] * len(LABELS)], [none] * n
    for i in range(n - 1, -1, -1):
        starts[i] = [beyond[i + 1][0], *(_logsum([scores[k][y - 1] + beyond[segments[k][1]][y] for k in by_start.get(i, ())]) for y in labels[1:])]
        beyond[i] = [_logsum([move[x][y] + starts[i][y] for y in labels]) for x in labels]
    return into, beyond, starts, _logsum(forward[n]), forward


def _logsum(x: list[float]) -> float:
    top = max(x, default=-math.inf)
    return top + math.log(sum(math.exp(v - top) for v in x)) if top > -math.inf else top


def training_sentences(count: int = 1000, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Invented sentences with their entities, made by rule."""
    rng = random.Random(seed)
    pick = rng.choice
    hexes, uppers, every = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, n: "".join(pick(chars) for _ in range(n))
    word = lambda: some("abcdefghijklmnopqrstuvwxyz", rng.randint(2, 11))

    def digit_in(make):
        made = make()
        return made if _DIGIT.search(made) else digit_in(make)

    def secret() -> tuple[str, str, str]:
        form = rng.randrange(12)
        if form == 8:  # a key in PEM form
            kind = pick(("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "))
            lines = "\n".join(some(every + "+/", 64) for _ in range(rng.randint(1, 6)))
            return pick(("", "", "key = \"", "private_key: ")), f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----", ""
        if form > 8:  # short, or with marks
            body = some(every, rng.randint(3, 12)) + some("0123456789", rng.randint(1, 4))
            body = word() + some("0123456789", rng.randint(1, 4)) if rng.random() < 0.4 else body
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(body) - 1)
                body = body[:at] + pick("!@#$%^&*?~=|(") + body[at:]
            name, quote = pick(("password", "passwd", "pwd", "passwort", "kennwort", "passphrase", "secret", "db_password", "user_pwd")), pick(('"', "'", "", ""))
            return f"{name}{pick(('=', ': ', ' = ', ':'))}{quote}", body, quote
        if form == 0:
            return "", pick("AG") + pick("KS") + "I" + pick("AP") + digit_in(lambda: some(uppers, 16)), ""
        if form == 1:
            return pick(("", "authorization: bearer ", "token: ")), "eyJ" + ".".join(digit_in(lambda: some(every, rng.randint(16, 160))) for _ in range(3)), ""
        if form == 2:
            return pick(("", "key ", "token = ")), pick(("ghp_", "sk_", "xoxb-", "AIza")) + digit_in(lambda: some(every, rng.randint(24, 44))), ""
        value = digit_in(lambda: some(pick((hexes, hexes, hexes.upper(), every)), pick((16, 18, 20, 24, 32, 40, 48, 64, 96, 160, 400))))
        if form == 3:
            value = pick((lambda: "".join(word() for _ in range(rng.randint(3, 6))), lambda: some(every[:52], rng.randint(10, 40)), lambda: some(every, rng.randint(9, 16))))()
            value = value if len(value) >= 12 else value + some("abcdefghijklmnopqrstuvwxyz", 12)
        name = pick(("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "key"))
        name = name.upper() if rng.random() < 0.2 else name
        return (f'{name} = "', value, '"') if form < 6 else (f"{name}{pick(('=', ': ', ' = '))}", value, "")

    def iban() -> tuple[str, str, str]:
        body = some("0123456789", rng.randint(13, 24))
        body = some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4) + body[4:] if rng.random() < 0.3 else body
        flat = some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2) + some("0123456789", 2) + body
        return pick(("", "iban ", "IBAN ", "IBAN: ", "account ")), flat if rng.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)), ""

    def ssn() -> tuple[str, str, str]:
        return pick(("", "ssn ", "ssn: ", "social security ")), f"{some('0123456789', 3)}-{some('0123456789', 2)}-{some('0123456789', 4)}", ""

    def other() -> str:
        cue = lambda: pick(("token", "secret", "password", "key", "the password", "api key", "account"))
        digest = lambda: some(hexes, pick((32, 40, 64)))
        return pick((
            lambda: some("0123456789", rng.randint(8, 17)), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
            lambda: f"{word()}{rng.randint(1, 99)}", lambda: f"{some('ABCDEFGH', 2)}-{some('0123456789', 6)}", lambda: f"{word()}-{rng.randint(1, 999)}", lambda: f"{word()}_{word()}_{rng.randint(1, 99)}",
            lambda: f"({some('0123456789', 3)}) 555-{some('0123456789', 4)}", lambda: f"{word()}/{word()}/{rng.randint(1, 9999)}", lambda: " ".join(some("0123456789", 4) for _ in range(4)), lambda: word().upper() + str(rng.randint(1, 99)),
            lambda: f"{rng.randint(1000000, 99999999)} {word()}", lambda: f"{word()}{word()}{rng.randint(1000, 9999)}",
            lambda: pick(("", "commit ", "sha256 ", "md5: ", "checksum ", "revision ")) + digest(), lambda: pick(("", "uuid ", "id=")) + "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)),
            lambda: f"{cue()} {word()}{pick(('ation', 'ing', 'ed', 'ment'))}", lambda: f"{cue()}{pick((': ', ' = ', '='))}{pick(('required', 'none', 'null', 'invalid', 'optional', 'disabled', 'unchanged', 'incorrect'))}",
            lambda: f"{cue()}{pick((': ', ' = ', '='))}{word()[:8]}", lambda: f'{cue()}{pick((": ", " = ", "="))}"{" ".join(word() for _ in range(rng.randint(1, 6)))}"'.replace('"', pick(('"', "'"))), lambda: f"{cue()}: {pick(('(', '[', '$', '%', '<', '{'))}{word()}{pick((')', ']', '}', '>', ''))}", lambda: f"{cue()}{pick((': ', '=', ' = '))}{pick(('${', '{{', '$', '%'))}{word().upper()}{pick(('', '_' + word().upper()))}{pick(('}', '}}', '%', ''))}", lambda: f"{pick(('Key', 'key', 'token', 'Password'))}{pick((': ', ' = '))}{pick((some(uppers[:26], rng.randint(1, 3)), word().title(), word().upper()))}",
            lambda: f"{pick(('key', 'sort_key', 'foreign key'))}{pick((': ', '='))}{pick((word() + '_id', str(rng.randint(1, 9999)), word() + '.' + word()))}",
            lambda: f"{word()}{rng.randint(1, 99)}.{word()}.com", lambda: f"{word()}.{rng.randint(2000, 2030)}.pdf", lambda: f"{rng.randint(1, 999)}.{some('0123456789', 6)}", lambda: f"{word()}{word().title()}{word().title()}{pick(('', '2'))}",
            lambda: f"{word()}{word()}{word()}", lambda: f"https://{word()}.org/{word()}/{rng.randint(1000, 99999999)}",
        ))()

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(2, 4)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            if rng.random() < 0.5:
                kind = pick(("secret", "secret", "iban", "ssn"))
                left, value, right = {"secret": secret, "iban": iban, "ssn": ssn}[kind]()
                spans.append((kind, len(text) + len(left), len(text) + len(left) + len(value)))
                text += left + value + right + pick((" ", ", ", ". "))
            else:
                text += other() + pick((" ", ", ", ". "))
        out.append((text, spans))
    return out


@lru_cache(1)
def trained() -> dict[tuple[str, str], float]:
    model = SemiCrf()
    model.train(training_sentences())
    return {k: w for k, w in model.weights.items() if abs(w) > 1e-3}


def _cores(text: str, whole: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged neighbourhoods of the places where an entity can be."""
    n = len(text)
    found: list[tuple[int, int]] = []
    if _DIGIT.search(text):
        found += [m.span() for m in _WITH_DIGIT.finditer(text) if m.end() - m.start() >= MIN_CORE]
        found += [(m.start(), min(n, m.end() + 40)) for m in _SPACED.finditer(text)]
    found += [m.span() for m in _LETTERS.finditer(text) if len(_TURN.findall(text, m.start(), m.end())) > 2]
    found += whole
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        lo, hi = max(0, a - AROUND), min(n, b + AROUND)
        while 0 < lo < a and text[lo - 1] in _WORDY:
            lo += 1
        while b < hi < n and text[hi] in _WORDY:
            hi -= 1
        if out and lo <= out[-1][1] + 2:  # a mark or a blank between them
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def added_spans(text: str, model: SemiCrf, base: list[Span]) -> list[Span]:
    """Spans that the model adds beside the base spans."""
    out: list[Span] = []
    whole = values(text)
    within, at = frozenset(whole), 0
    for lo, hi in _cores(text, whole):
        upto = at
        while upto < len(whole) and whole[upto][1] <= hi:
            upto += 1
        out += model.decode(text, tokenize(text, lo, hi, whole[at:upto]), within)
        at = upto
    if not out or not base:
        return out
    begins = [a for _, a, _ in base]
    ends = list(accumulate((b for _, _, b in base), max))

    def stands(a: int, b: int) -> bool:
        lo, hi = bisect_left(begins, a), bisect_left(begins, b)
        return (not lo or ends[lo - 1] <= a) and all(y <= b and (x, y) != (a, b) for _, x, y in base[lo:hi])

    return [s for s in out if stands(s[1], s[2])]


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (touching ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redacted: bool = False) -> DataFrame:
    """``keep`` columns, doc_id, counts of the base kinds, base_sha256 and spans of every row.

    With ``redacted`` also the text with all spans replaced. A narrow map.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    weights = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf()
        model.weights = weights.value
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + added_spans(text, model, base), key=_place)
                kinds = [k for k, _, _ in base]
                row = [kinds.count(k) for k in BASE] + [hashlib.sha256(told(base).encode()).hexdigest(), told(spans)]
                rows.append(row + [redact(text, spans)] * redacted)
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=[*batch.schema.names[:-1], *names])

    names = [f"n_{k}" for k in BASE] + ["base_sha256", "spans"] + ["redacted"] * redacted
    types = [pa.int64()] * len(BASE) + [pa.string(), pa.string()] + [pa.string()] * redacted
    own = docs.select(*(F.col(c) for c in keep if c not in (id_col, *names)), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_searched_text"))
    fields = [T.StructField(n, T.LongType() if t == pa.int64() else T.StringType()) for n, t in zip(names, types, strict=True)]
    return own.mapInArrow(tidy(run), T.StructType([*own.schema.fields[:-1], *fields]))
