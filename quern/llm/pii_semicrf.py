"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

Method
    A segmentation of the tokens gives each segment a type: email, ip, card or phone for a span of at most MOST_TOKENS
    tokens and MOST_CHARS characters, or none for a single token. Features look at the whole span (its form, digits, check digit, separators,
    length), what bounds it and the three words before the stretch. Dynamic programming over segment ends takes the best segmentation, so that
    boundaries and types are chosen together. A span of personal data holds a digit or '@'; so the programme runs over stretches of pieces
    with one, and what lies between is none. The field is trained here on generated texts with a fixed seed. span_features() says what the
    features are; decoding computes the same ones for all candidate spans of many stretches at once.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import apart, map_batches, prepare, texts

KINDS = ("email", "ip", "card", "phone")
#: Contract of the base spans (fixed patterns). An address is found from its '@'; a run of digits is entered at its first one only.
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MOST_TOKENS, MOST_CHARS = 20, 80
SEED, EXAMPLES, ROUNDS = 11, 260, 60
_DIGIT = re.compile(r"[0-9]")
_PIECE = re.compile(r"\S+")
_ANCHOR = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_ADDRESS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_EMAIL_FORM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CUES = {
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "telefon", "téléphone", "teléfono"), "email": ("mail", "email", "contact", "write", "e-mail", "correo"), "ip": ("ip", "host", "server", "address", "from", "client"), "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta", "amex"),
}


#: What may stand right before and right after personal data.
_LEFT, _RIGHT = frozenset(" \t\n([<\"':=,;/|*#$&"), frozenset(" \t\n)]>\"':;,/|!?*#$&%")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _is_address(text: str) -> bool:
    return _ADDRESS.fullmatch(text) is not None and _octets(text)


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), leftmost and without overlaps in each kind, in that order."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if _octets(m[0])]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def stretches(text: str) -> list[tuple[int, str, tuple[str, ...]]]:
    """(start, stretch, the three pieces before) of each run of pieces with a digit or '@'."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    out, begun, end, before = [], -1, 0, ()
    last: deque[str] = deque(maxlen=3)
    for m in _PIECE.finditer(text):
        if _ANCHOR.search(m[0]):
            if begun < 0:
                begun, before = m.start(), tuple(last)
            end = m.end()
        elif begun >= 0:
            out.append((begun, text[begun:end], before))
            begun = -1
        last.append(m[0])
    return out if begun < 0 else [*out, (begun, text[begun:end], before)]


def tokens(stretch: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(stretch)]


def candidates(stretch: str, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Segments (first token, last token + 1) that can be personal data."""
    out = []
    for i, (a, _) in enumerate(at):
        if not (stretch[a].isalnum() or stretch[a] in "+("):
            continue
        anchor = False
        for j in range(i, min(len(at), i + MOST_TOKENS)):
            b, e = at[j]
            if e - a > MOST_CHARS or (j > i and b - at[j - 1][1] > 1):
                break
            anchor |= _ANCHOR.search(stretch, b, e) is not None
            if anchor and stretch[e - 1].isalnum():
                out.append((i, j + 1))
    return out


def span_features(stretch: str, a: int, b: int, cues: frozenset[str]) -> list[str]:
    """Features of a whole span; cues: kinds whose words stand before the stretch."""
    s = stretch[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, letters = len(digits), any(c.isalpha() for c in s)
    other = {c for c in s if not c.isalnum()}
    form = "email" if "@" in s and _EMAIL_FORM.fullmatch(s) else "at" if "@" in s else "quad" if s.count(".") == 3 and other == {"."} and not letters else "mixed" if letters else "plus" if s[0] == "+" else "digits"
    before, after = stretch[a - 1] if a else " ", stretch[b : b + 2]
    open_left = before in _LEFT
    open_right = not after or after[0] in _RIGHT or after[0] == "." and not after[1:].strip()
    size = next(k for k, most in enumerate((3, 6, 7, 9, 10, 12, 15, 16, 19, 1 << 62)) if n <= most)
    out = ["bias", f"form={form}", f"left={open_left:d}", f"right={open_right:d}", f"bound={open_left and open_right:d}{form}", f"tail={len(s) > 48:d}"]
    if form == "quad":
        return [*out, f"octets={_is_address(s):d}", *(f"cue={c}" for c in cues)]
    if form in ("digits", "plus"):
        groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
        seps = "".join(sorted(other - {"+"}))
        out += [f"{form}n={size}", f"luhn={n >= 13 and luhn(digits):d}n={size}", f"seps={seps if len(seps) < 4 else 'many'}", f"groups={min(6, len(groups))}{form}", f"even={len(groups) > 2 and set(groups) == {4}:d}", f"local={groups == [3, 3, 4] or groups == [3, 4] or groups == [2, 2, 2, 2, 2]:d}"]
    return [*out, *(f"cue={c}{form}" for c in cues), *(f"cue={c}n={size}" for c in cues)]


_CUE_SIZE = max(len(w) for v in _CUES.values() for w in v) + 10


def cue_kinds(before: tuple[str, ...]) -> frozenset[str]:
    words = {w.strip(".,:;()").lower() for w in before if len(w) <= _CUE_SIZE}
    return frozenset(k for k, v in _CUES.items() if words & set(v))


_FORMS = ("email", "at", "quad", "mixed", "plus", "digits")
_SIZES = (3, 6, 7, 9, 10, 12, 15, 16, 19)
_KIND = re.compile(r"([0-9]+)|([^\W\d_]+)|(\S)")
_DOMAIN_PART = re.compile(r"[A-Za-z0-9.-]+")
#: Tokens whose spans are scored together, and stretches whose result a worker remembers.
CHUNK, REMEMBERED = 2000, 20_000


class _Tokens:
    """The tokens of some stretches in a row, and sums over them from which features of any span follow."""

    def __init__(self, units: list[str], seps: dict[str, int]) -> None:
        self.units = units
        a, b, kind, unit, char, left, right, first = [], [], [], [], [], [], [], []
        gaps = []
        for u, s in enumerate(units):
            end, n = None, len(s)
            for m in _KIND.finditer(s):
                x, y = m.span()
                k = m.lastindex
                c = s[x] if k == 3 else ""
                gaps.append("" if end is None or x == end else s[end:x])
                a.append(x)
                b.append(y)
                kind.append(k)
                unit.append(u)
                char.append(c)
                first.append(k < 3 or c.isalnum())
                left.append(not x or s[x - 1] in _LEFT)
                right.append(y == n or s[y] in _RIGHT or s[y] == "." and not s[y + 1 : y + 2].strip())
                end = y
        self.a, self.b, self.unit = np.array(a, np.int64), np.array(b, np.int64), np.array(unit)
        kind, self.alnum = np.array(kind, np.int8), np.array(first, bool)
        self.char, self.left, self.right = char, np.array(left, bool), np.array(right, bool)
        one = lambda c: np.array([x == c for x in char], bool)
        plus, at, dot = one("+"), one("@"), one(".")
        self.plus, self.begins = plus, self.alnum | plus | one("(")
        self.ats = np.flatnonzero(at)
        gap = np.array([len(g) for g in gaps])
        # a span may not cross from one part to the next
        self.part = np.cumsum(np.r_[0, (self.unit[1:] != self.unit[:-1]) | (gap[1:] > 1)])
        total = lambda x: np.r_[0, np.cumsum(x)]
        digit = kind == 1
        size = np.where(digit, self.b - self.a, 0)
        self.anchors, self.n_at, self.n_dot = total(digit | at), total(at), total(dot)
        letters = kind == 2
        for i in np.flatnonzero(letters):  # numerals other than digits are no letters
            t = units[unit[i]][a[i] : b[i]]
            letters[i] = t.isascii() or any(map(str.isalpha, t))
        self.n_letters, self.n_other, self.n_gap = total(letters), total(~self.alnum), total(gap == 1)
        self.n_digits, self.n_groups, self.n_four = total(size), total(digit), total(size * digit == 4)
        self.groups = np.r_[size[digit], 0, 0, 0, 0, 0]
        value = np.array([int(c) for i in np.flatnonzero(digit) for c in units[unit[i]][a[i] : b[i]]], np.int64)
        double = np.where(value > 4, 2 * value - 9, 2 * value)
        even = np.arange(len(value)) % 2 == 0
        self.luhn = total(np.where(even, value, double)), total(np.where(even, double, value))
        # one row for each separator that the field knows, and a last one for all others; a gap's separator stands before its token
        rows = len(seps) + 1
        inside, before = np.zeros((rows, len(a)), np.int32), np.zeros((rows, len(a)), np.int32)
        for i, (c, g) in enumerate(zip(char, gaps, strict=True)):
            if c and c != "+" and not c.isalnum():
                inside[seps.get(c, rows - 1), i] = 1
            if len(g) == 1:
                before[seps.get(g, rows - 1), i] = 1
        zero = np.zeros((rows, 1), np.int32)
        self.inside, self.before = np.hstack([zero, inside.cumsum(1)]), np.hstack([zero, before.cumsum(1)])

    def email_forms(self) -> set[tuple[int, int]]:
        """(first token, last token + 1) of all spans that are an address as a whole, of at most MOST_TOKENS tokens."""
        out = set()
        for m in self.ats.tolist():
            s, low, high = self.units[self.unit[m]], m, m
            while low > 0 and m - low < MOST_TOKENS and self.unit[low - 1] == self.unit[m] and self.b[low - 1] == self.a[low] and (self.char[low - 1] in "._%+-" if self.char[low - 1] else s[self.a[low - 1] : self.b[low - 1]].isascii()):
                low -= 1
            most = low + MOST_TOKENS if low < m else 0
            while high + 1 < len(self.a) and high - m < MOST_TOKENS and self.unit[high + 1] == self.unit[m] and self.b[high] == self.a[high + 1] and _DOMAIN_PART.fullmatch(s, self.a[high + 1], self.b[high + 1]):
                high += 1
            ends = [j + 1 for j in range(m + 1, high + 1) if most and DOMAIN.fullmatch(s, self.a[m] + 1, self.b[j])]
            out |= {(i, j) for i in range(low, m) for j in ends if j - i <= MOST_TOKENS}
        return out


class SemiField:
    """Scores of the kinds for a span: weights by feature and kind. None scores 0."""

    def __init__(self, index: dict[str, int], weights: np.ndarray) -> None:
        self.index, self.weights, self.known = index, weights, {}
        of = lambda name: weights[index[name]] if name in index else np.zeros(len(KINDS))
        self.form = np.array([[[[of("bias") + of(f"form={f}") + of(f"left={x:d}") + of(f"right={y:d}") + of(f"bound={x and y:d}{f}") + of(f"tail={z:d}") for z in (0, 1)] for y in (0, 1)] for x in (0, 1)] for f in _FORMS])
        sizes = [*range(len(_SIZES) + 1)]
        self.size = np.array([[[of(f"{f}n={n}") + of(f"luhn={x:d}n={n}") for x in (0, 1)] for n in sizes] for f in _FORMS[4:]])
        self.grouped = np.array([[[[of(f"groups={g}{f}") + of(f"even={x:d}") + of(f"local={y:d}") for y in (0, 1)] for x in (0, 1)] for g in range(7)] for f in _FORMS[4:]])
        self.octets = np.array([of(f"octets={x:d}") for x in (0, 1)])
        self.cue_quad = {c: of(f"cue={c}") for c in KINDS}
        self.cue_form = {c: np.array([of(f"cue={c}{f}") for f in _FORMS]) for c in KINDS}
        self.cue_size = {c: np.array([of(f"cue={c}n={n}") for n in sizes]) for c in KINDS}
        sets = [f.removeprefix("seps=") for f in index if f.startswith("seps=") and f != "seps=many"]
        self.seps = {c: i for i, c in enumerate(sorted(set("".join(sets))))}
        self.sep_sets, self.many = {sum(1 << self.seps[c] for c in x): of(f"seps={x}") for x in sets}, of("seps=many")

    def __reduce__(self):
        return SemiField, (self.index, self.weights)

    def _separators(self, t: _Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The weights of the set of separators in each span."""
        has = np.array([(t.inside[r][j] > t.inside[r][i]) | (t.before[r][j] > t.before[r][i + 1]) for r in range(len(self.seps) + 1)])
        mask = (has[:-1] * (1 << np.arange(len(self.seps), dtype=np.int64))[:, None]).sum(0)
        values, which = np.unique(mask, return_inverse=True)
        out = np.array([self.many if int(v).bit_count() > 3 else self.sep_sets.get(int(v), np.zeros(len(KINDS))) for v in values]).reshape(-1, len(KINDS))[which]
        for k in np.flatnonzero(has[-1]):  # separators that the field does not know: only how many there are matters
            s = t.units[t.unit[i[k]]][t.a[i[k]] : t.b[j[k] - 1]]
            out[k] = self.many if len({c for c in s if not c.isalnum()} - {"+"}) > 3 else 0
        return out

    def scored(self, t: _Tokens, cues: list[frozenset[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First token, last token + 1, score and kind of the candidates that score above none."""
        email, found = t.email_forms(), []
        starts = np.flatnonzero(t.begins)
        for at in range(0, len(starts), CHUNK):
            i = np.repeat(starts[at : at + CHUNK], MOST_TOKENS)
            j = i + np.tile(np.arange(1, MOST_TOKENS + 1), len(i) // MOST_TOKENS)
            ok = j <= len(t.a)
            i, j = i[ok], j[ok]
            size = t.b[j - 1] - t.a[i]
            ok = (t.part[j - 1] == t.part[i]) & (size <= MOST_CHARS) & t.alnum[j - 1] & (t.anchors[j] > t.anchors[i])
            i, j, size = i[ok], j[ok], size[ok]
            count = lambda x: x[j] - x[i]
            letters = count(t.n_letters) > 0
            other = count(t.n_other) + t.n_gap[j] - t.n_gap[i + 1]
            form = np.where(letters, 3, np.where(t.plus[i], 4, 5))
            form[(count(t.n_dot) == 3) & (other == 3) & ~letters] = 2
            with_at = np.flatnonzero(count(t.n_at) > 0)
            form[with_at] = [0 if (x, y) in email else 1 for x, y in zip(i[with_at].tolist(), j[with_at].tolist(), strict=True)]
            score = self.form[form, t.left[i].astype(int), t.right[j - 1].astype(int), (size > 48).astype(int)]
            n = count(t.n_digits)
            bucket = np.searchsorted(_SIZES, n)
            d = np.flatnonzero(form >= 4)
            if len(d):
                p, q, kind, groups, first = t.n_digits[i[d]], t.n_digits[j[d]], form[d] - 4, count(t.n_groups)[d], t.n_groups[i[d]]
                total = np.where(q % 2 == 1, t.luhn[0][q] - t.luhn[0][p], t.luhn[1][q] - t.luhn[1][p])
                size_of = lambda k: t.groups[first + k]
                even = (groups > 2) & (count(t.n_four)[d] == groups)
                local = (groups == 3) & (size_of(0) == 3) & (size_of(1) == 3) & (size_of(2) == 4) | (groups == 2) & (size_of(0) == 3) & (size_of(1) == 4)
                local |= (groups == 5) & (size_of(0) == 2) & (size_of(1) == 2) & (size_of(2) == 2) & (size_of(3) == 2) & (size_of(4) == 2)
                score[d] += self.size[kind, bucket[d], ((n[d] >= 13) & (total % 10 == 0)).astype(int)]
                score[d] += self.grouped[kind, np.minimum(6, groups), even.astype(int), local.astype(int)]
                score[d] += self._separators(t, i[d], j[d])
            for k in np.flatnonzero(form == 2):
                s = t.units[t.unit[i[k]]][t.a[i[k]] : t.b[j[k] - 1]]
                score[k] += self.octets[int(_is_address(s))]
            for c in KINDS:
                has = np.array([c in x for x in cues])[t.unit[i]]
                if has.any():
                    score[has & (form == 2)] += self.cue_quad[c]
                    has &= form != 2
                    score[has] += self.cue_form[c][form[has]] + self.cue_size[c][bucket[has]]
            kind = score.argmax(1)
            best = score[np.arange(len(i)), kind]
            above = best > 0  # below, single tokens of none are better
            found.append((i[above], j[above], best[above], kind[above]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 4

    def decoded(self, units: list[tuple[str, frozenset[str]]]) -> list[tuple[tuple[int, int, int], ...]]:
        """The spans (kind's number, start, end) of the best segmentation of each stretch with its cues."""
        t = _Tokens([s for s, _ in units], self.seps)
        out: list[list[tuple[int, int, int]]] = [[] for _ in units]
        if not len(t.a):
            return [()] * len(units)
        i, j, score, kind = self.scored(t, [c for _, c in units])
        # the best score up to each token's end; tokens without candidates that end there add nothing
        order = np.argsort(j, kind="stable")
        ends, best, back = [0], [0.0], [None]  # places where the best score rises
        for x, y, v, k in zip(i[order].tolist(), j[order].tolist(), score[order].tolist(), kind[order].tolist(), strict=True):
            s = best[bisect_right(ends, x) - 1] + v
            if s > best[-1]:
                if ends[-1] == y:
                    best[-1], back[-1] = s, (x, k)
                else:
                    ends.append(y)
                    best.append(s)
                    back.append((x, k))
        at = len(ends) - 1
        while at > 0:
            x, k = back[at]
            y = ends[at]
            out[t.unit[x]].append((k, int(t.a[x]), int(t.b[y - 1])))
            at = bisect_right(ends, x) - 1
        return [tuple(reversed(x)) for x in out]

    def spans_of(self, stretch: str, cues: frozenset[str]) -> tuple[tuple[int, int, int], ...]:
        return self.decoded([(stretch, cues)])[0]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        return self.spans_of_all([text])[0]

    def spans_of_all(self, every: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind's number, start, end) of the best segmentation of each text."""
        units = [[(start, (s, cue_kinds(before))) for start, s, before in stretches(t)] for t in every]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        now: dict = {}
        todo, size = [], 0
        for unit in dict.fromkeys(u for row in units for _, u in row if u not in self.known):
            todo.append(unit)
            size += len(unit[0])
            if size > 5 * CHUNK:
                now.update(zip(todo, self.decoded(todo), strict=True))
                todo, size = [], 0
        now.update(zip(todo, self.decoded(todo), strict=True))
        self.known.update((u, x) for u, x in now.items() if len(u[0]) < 200)
        return [[(k, start + a, start + b) for start, u in row for k, a, b in (now[u] if u in now else self.known[u])] for row in units]


def generated_text(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of invented words, personal data and other numbers; and the spans of personal data."""
    syllables = ["an", "er", "th", "ou", "ing", "le", "des", "ar", "mi", "ka", "to", "ung", "sch", "ci", "que", "re"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))

    def card() -> str:
        n = r.choice((15, 16, 16, 16, 16, 19))
        body = r.choice(("4", "5", "37", "6")) + digits(n)
        body = body[: n - 1]
        body += next(c for c in string.digits if luhn(body + c))
        sep = r.choice(("", "", " ", "-"))
        return sep.join(body[i : i + 4] for i in range(0, n, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 99)}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(1, 99)}.{a}.{b}.{c}"))

    make = (
        lambda: r.choice((f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com", f"{word()}@{word()}.org", f"{word()}_{word()}@{word()}.{word()}.net", f"{word()}+{word()}@{word()}-{word()}.io")),
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card, phone,
    )
    other = (
        lambda: digits(r.randint(1, 6)), lambda: f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{r.randint(256, 999)}.{digits(3)}.{r.randint(300, 999)}.{digits(2)}", lambda: f"{digits(3)},{digits(3)}.{digits(2)}",
        lambda: next(c for c in iter(lambda: digits(16), None) if not luhn(c)), lambda: digits(8), lambda: digits(12), lambda: f"@{word()}", lambda: f"{word()}@{word()}", lambda: f"{word()}{digits(2)}", lambda: f"AKIA{digits(2)}{word().upper()}{digits(4)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(32)), lambda: f"{digits(4)} {digits(2)} {digits(4)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}",
    )
    out, spans = "", []
    for _ in range(r.randint(2, 4)):
        out += " ".join(word() for _ in range(r.randint(1, 3))) + " "
        if r.random() < 0.7:
            k = r.randrange(4)
            if r.random() < 0.4:
                out += r.choice(_CUES[KINDS[k]]) + r.choice((" ", ": "))
            s = make[k]()
            spans.append((k, len(out), len(out) + len(s)))
            out += s
        else:
            out += r.choice(other)()
        out += r.choice((" ", ". ", ", ", "\n", " "))
    return out, spans


@cache
def trained() -> SemiField:
    """Weights by conditional likelihood of segmentations with an L2 penalty (Adam)."""
    r, index, cases = random.Random(SEED), {}, []
    for _ in range(EXAMPLES):
        text, spans = generated_text(r)
        for start, s, before in stretches(text):
            at, cues = tokens(s), cue_kinds(before)
            segs = candidates(s, at)
            if not segs:
                continue
            rows = [[index.setdefault(f, len(index)) for f in span_features(s, at[i][0], at[j - 1][1], cues)] for i, j in segs]
            gold = [(n, k) for n, (i, j) in enumerate(segs) for k, a, b in spans if (start + at[i][0], start + at[j - 1][1]) == (a, b)]
            cases.append((len(at), segs, rows, gold))
    wide = max(len(x) for _, _, rows, _ in cases for x in rows)
    pad = len(index)
    ids = np.array([x + [pad] * (wide - len(x)) for _, _, rows, _ in cases for x in rows])
    first = np.cumsum([0, *(len(rows) for _, _, rows, _ in cases)])
    target = np.zeros((len(ids), 4))
    for c, (*_, gold) in enumerate(cases):
        for n, k in gold:
            target[first[c] + n, k] = 1
    w = np.zeros((pad + 1, 4))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        w[pad] = 0
        score = w[ids].sum(1)
        top = score.max(1)
        whole = top + np.log(np.exp(score - top[:, None]).sum(1))  # all kinds of a segment together
        p = np.zeros(len(ids))
        for c, (n, segs, *_) in enumerate(cases):
            z = whole[first[c] : first[c + 1]].tolist()
            a, b = [0.0] * (n + 1), [0.0] * (n + 1)
            by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            by_start: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            for (i, j), x in zip(segs, z, strict=True):
                by_end[j].append((i, x))
                by_start[i].append((j, x))
            for j in range(1, n + 1):
                ways = [a[j - 1], *(a[i] + x for i, x in by_end[j])]
                a[j] = (t := max(ways)) + np.log(sum(np.exp(np.array(ways) - t))) if len(ways) > 1 else ways[0]
            for i in range(n - 1, -1, -1):
                ways = [b[i + 1], *(b[j] + x for j, x in by_start[i])]
                b[i] = (t := max(ways)) + np.log(sum(np.exp(np.array(ways) - t))) if len(ways) > 1 else ways[0]
            p[first[c] : first[c + 1]] = np.exp(np.minimum(0, [a[i] + x + b[j] - a[n] for (i, j), x in zip(segs, z, strict=True)]))
        own = p[:, None] * np.exp(score - whole[:, None]) - target
        g = np.stack([np.bincount(ids.ravel(), np.repeat(own[:, k], wide), pad + 1) for k in range(4)], 1) + 0.02 * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return SemiField(index, w[:pad])


def scan(text: str, field: SemiField, found: list[tuple[int, int, int]] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans; and all spans with the field's (found), as far as they do not overlap base ones. By kind, then start."""
    base = base_spans(text)
    found = field.spans(text) if found is None else found
    extra = [s for s, ok in zip(found, apart([s[1:] for s in found], [s[1:] for s in base]), strict=True) if ok]
    return base, sorted([*base, *extra])


def scan_all(every: list[str], field: SemiField) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    return [scan(t, field, found) for t, found in zip(every, field.spans_of_all(every), strict=True)]


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in capitals and angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


class _Scan:
    def __init__(self, field: SemiField) -> None:
        self.field = field

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = scan_all(texts(batch), self.field)
        printed = [[",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in part) for part in row] for row in rows]
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in range(4)]
        digest = pa.array([hashlib.sha256(base.encode()).hexdigest() for base, _ in printed])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([x for _, x in printed], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


class _Redact:
    def __init__(self, field: SemiField) -> None:
        self.field = field

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan_all(texts(batch), self.field)
        new = [t if t is None else redacted(t, spans) for t, (_, spans) in zip(batch.column("text").to_pylist(), found, strict=True)]
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))


def pii_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (columns doc_id, text; others are ignored).

    Null text is empty: counts 0, the digest of the empty string, no spans. spans lists kind:start:end in code points, by kind and
    then start; the field's spans never overlap base ones, and have at most MOST_TOKENS tokens and MOST_CHARS characters. Repeated rows are
    judged alike. Texts are scanned whole, in time in proportion to their length. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), _Scan(trained()), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kind; null text stays null, other columns stay as they are.

    What is replaced are the spans of pii_scan(), in texts of any length. Repeated rows are changed alike; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    return map_batches(docs, _Redact(trained()), docs.schema)
