"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Method
    Text is cut into tokens. Each token is the beginning (B) or inside (I) of a secret or outside (O). Features are the token's
    shape, the tokens around it, and features of the whole file. A short word of one case without a digit, '_', '+' or '/' that
    follows no cue (':', '=', or a word like password), and punctuation between spaces, can only be O; so the chain parts exactly
    there, and Viterbi runs over the stretches between.
    The field is trained here by conditional likelihood on generated files, whose secrets are known, with a fixed seed.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import apart, map_batches, prepare, texts

#: Contract of the base spans (fixed patterns).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex")

_PIECE = re.compile(r"\S+")
#: What a word that follows no cue must have to be judged: a mark, a mix of cases, or the least length of a secret without a cue.
_MARK = re.compile(r"[0-9_+/]|[a-z][A-Z]|[A-Z]{2}[a-z]|(?=-*[A-Za-z])[A-Za-z-]{16}")
_STEM = re.compile(r"pass(?:word|wd|phrase|code)?|pwd|secret|token|key|auth(?:orization)?|bearer|credentials?", re.IGNORECASE)
#: A cue, and what may stand between it and its word, at whose beginning the match ends.
_CUE = re.compile(rf"""(?:[:=]|(?:{_STEM.pattern})(?:\s+is\b)?)[\s"'`(\[{{<>=:]*+""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
_WORD = re.compile(r"[A-Za-z0-9+/_-]")
TAGS = ("B", "I", "O")
O = 2
SEED, EXAMPLES, ROUNDS = 7, 1600, 150


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), leftmost and without overlaps in each kind, in the order of start and then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def file_features(text: str) -> list[str]:
    """Features of the whole file, shared by its tokens."""
    lines = text.count("\n") + 1
    settings = text.count("=") + text.count(": ")
    return [f"F=set{min(3, 8 * settings // lines)}", f"F=code{min(2, (text.count('{') + text.count(';')) * 4 // lines)}"]


def shape(token: str) -> list[str]:
    low = sum(c.islower() for c in token)
    up = sum(c.isupper() for c in token)
    num = sum(c.isdigit() for c in token)
    n = len(token)
    kinds = f"{low > 0:d}{up > 0:d}{num > 0:d}{n > low + up + num:d}"
    mixed = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    size = next(k for k, most in enumerate((3, 5, 7, 9, 12, 15, 19, 23, 31, 39, 63, 1 << 62)) if n <= most)
    hexadecimal = all(c in "0123456789abcdefABCDEF" for c in token)
    return [f"S={kinds}", f"S=len{size}", f"S={kinds}len{size}", f"S=mix{min(6, mixed)}", f"S=mix{min(6, mixed)}len{size}", f"S=var{int(8 * len(set(token)) / n)}", f"S=hex{hexadecimal:d}len{size}", f"S=head{token[:3].lower() if n > 12 else ''}"]


def stretches(text: str) -> list[tuple[list[tuple[str, int, int]], list[bool], list[str], list[str]]]:
    """(tokens with places, which can be in a secret, the words before, the words after) of each stretch of marked pieces."""
    cued = [m.end() for m in _CUE.finditer(text)]
    if not cued and not _MARK.search(text):
        return []
    out, pieces = [], [(m[0], m.start()) for m in _PIECE.finditer(text)]
    marked, n = [], 0
    for p, at in pieces:
        while n < len(cued) and cued[n] < at:
            n += 1
        marked.append(n < len(cued) and cued[n] < at + len(p) or bool(_MARK.search(p)))
    cued = set(cued)
    k = 0
    while k < len(pieces):
        if not marked[k]:
            k += 1
            continue
        end = k
        while end < len(pieces) and marked[end]:
            end += 1
        tokens, free = [], []
        for piece, at in pieces[k:end]:
            found = [(m[0], at + m.start(), at + m.end()) for m in _TOKEN.finditer(piece)]
            for i, (t, start, _) in enumerate(found):
                word = bool(_WORD.match(t))
                free.append(start in cued or bool(_MARK.search(t)) if word else t in ".~$%&*@#!" and 0 < i < len(found) - 1)
            tokens += found
        before = [m[0] for p, _ in pieces[max(0, k - 3) : k] for m in _TOKEN.finditer(p[-200:])]
        after = [m[0] for p, _ in pieces[end : end + 1] for m in _TOKEN.finditer(p[:200])]
        out.append((tokens, free, before[-3:], after[:1]))
        k = end
    return out


def features(tokens: list[tuple[str, int, int]], before: list[str], after: list[str], whole: list[str], i: int) -> list[str]:
    t = [*before, *(x[0] for x in tokens[max(0, i - 3) : i])][-3:]
    words = [w.lower() for w in t if _WORD.match(w)]
    nxt = tokens[i + 1][0] if i + 1 < len(tokens) else (after or ["$"])[0]
    glued = i > 0 and tokens[i - 1][2] == tokens[i][1]
    own = shape(tokens[i][0])
    cue = [f"W={w}" for w in words[-2:]]
    mark = next((w for w in reversed(t) if not _WORD.match(w)), "") if t and not _WORD.match(t[-1]) else ""
    stem = any(_STEM.search(w) for w in words[-2:])
    return [*own, *cue, f"C={stem:d}", f"C={stem:d}{own[0]}", f"C={stem:d}{own[1]}P={mark}", f"P={mark}", f"P={mark}{own[1]}", f"N={nxt.lower() if len(nxt) < 9 else 'long'}", f"G={glued}", *whole, *(f"{c}{own[1]}" for c in cue)]


def _rand(r: random.Random, alphabet: str, a: int, b: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))


SYLLABLES = ["an", "er", "th", "ou", "ing", "le", "des", "ar", "mi", "ka", "to", "ung", "sch", "ci", "que", "re"]


def _word(r: random.Random, a: int = 1, b: int = 4) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(a, b)))


def digit_free_secret(r: random.Random) -> str:
    return r.choice((
        lambda: _rand(r, string.ascii_letters, 10, 40), lambda: _rand(r, string.ascii_lowercase, 8, 20), lambda: _rand(r, string.ascii_uppercase, 10, 24),
        lambda: "-".join(_word(r) for _ in range(r.randint(3, 5))), lambda: "".join(_word(r, 2).title() for _ in range(r.randint(2, 4))), lambda: _word(r, 4, 6),
    ))()


def _secret(r: random.Random) -> str:
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    if r.random() < 0.25:
        return digit_free_secret(r)
    return r.choice((
        lambda: _rand(r, hexa, 16, 64), lambda: _rand(r, alnum, 16, 48) + "7", lambda: "AKIA" + _rand(r, string.ascii_uppercase + "234567", 16, 16),
        lambda: r.choice(("ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "pk_test_", "rk_live_", "xoxb-", "hf_", "npm_", "shpat_")) + _rand(r, alnum, 20, 40),
        lambda: _rand(r, alnum + "+/", 30, 60) + "0" + r.choice(("", "=", "==")), lambda: "eyJ" + _rand(r, alnum, 20, 40) + "1." + "eyJ" + _rand(r, alnum, 20, 60) + "2." + _rand(r, alnum + "_-", 30, 43) + "3",
        lambda: _rand(r, alnum, 8, 14) + r.choice("0123456789"),
    ))()


def generated_file(r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A short file of invented words with settings, numbers and, mostly, one secret; and the secrets' places."""
    word = lambda: _word(r)
    prose = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    digits = lambda a, b: _rand(r, string.digits, a, b)
    cues = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth", "private_key", "bearer", "authorization", "passphrase", "credential", "signature_key", "db_pass"]
    plain = (
        lambda: digits(1, 5), lambda: f"{r.randint(1990, 2030)}-{digits(2, 2)}-{digits(2, 2)}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"+{r.randint(1, 49)} ({digits(3, 3)}) {digits(3, 3)}-{digits(4, 4)}",
        lambda: f"{word()}.{digits(1, 3)}@{word()}{digits(1, 1)}.example.com", lambda: digits(16, 16), lambda: " ".join(digits(4, 4) for _ in range(4)), lambda: f"https://{word()}.org/{word()}/{word()}{digits(1, 3)}", lambda: f"{word()}_{word()}", lambda: f"/usr/{word()}/{word()}",
        lambda: f"v{digits(1, 1)}.{digits(1, 2)}", lambda: f"{word()}{digits(1, 3)}", lambda: f"{word().title()}/{word().title()}", lambda: f"{digits(1, 3)},{digits(3, 3)}.{digits(2, 2)}", lambda: f"{word()} = {digits(1, 6)}", lambda: f"{word()}: {word()}_{digits(1, 2)}", lambda: f"{digits(1, 2)}:{digits(2, 2)}", lambda: f"{word()}_{word()}({word()}, {digits(1, 2)})",
        lambda: f"{_rand(r, '0123456789abcdef', 7, 8)}-{digits(4, 4)}", lambda: f"{r.choice(('id', 'page', 'port', 'count', 'version', 'size'))} = {digits(2, 8)}",
        lambda: f"{word()}: {word()}", lambda: f"{word()} = {word()}-{word()}", lambda: f"{word()}: {word()}-{word()}-{word()}", lambda: f"{word()}{word().title()}({word()})", lambda: word().title() + word().title(), lambda: _word(r, 5, 8), lambda: f"{word()}-{word()}-{word()}-{word()}", lambda: f"the {r.choice(cues[:5])} {r.choice(('of', 'is', 'for', 'and', 'in'))} {word()}", lambda: f"{word()} = {word()}{word().title()}",
    )
    out, spans = "", []
    for _ in range(r.randint(2, 4)):
        out += prose(2, 6) + r.choice((" ", ". ", ", ", "\n"))
        if r.random() < 0.6:
            q, eq = r.choice(("", '"', "'")), r.choice(("=", " = ", ": ", ":", " : "))
            s = _secret(r)
            cued = r.random() < 0.75 or len(s) < 16 or not re.search(r"\d|[a-z][A-Z].*[a-z][A-Z].*[a-z][A-Z]", s) or s.istitle()
            head = r.choice(cues) if cued else ""
            head = r.choice((head, head.upper(), f"{word()}_{head}")) + (eq if not head.startswith(("bearer", "auth")) or r.random() < 0.5 else " ") if cued else ""
            out += head + q
            spans.append((len(out), len(out) + len(s)))
            out += s + q + r.choice((" ", "\n", " ", "; "))
        else:
            out += r.choice(plain)() + r.choice((" ", ". ", ", ", "\n"))
    return out + prose(2, 5), spans


class Field:
    """A linear-chain conditional random field over B, I and O. I follows only B or I."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.index, self.weights, self.moves = index, weights, moves

    def emissions(self, rows: list[list[str]], free: list[bool]) -> np.ndarray:
        out = np.zeros((len(rows), 3))
        for i, row in enumerate(rows):
            if free[i]:
                out[i] = self.weights[[k for f in row if (k := self.index.get(f)) is not None]].sum(0)
            else:
                out[i, :O] = -1e9
        return out

    def viterbi(self, e: np.ndarray) -> list[int]:
        score = e[0] + np.array([0, -1e9, 0])
        back = []
        for x in e[1:]:
            step = score[:, None] + self.moves
            back.append(step.argmax(0))
            score = step.max(0) + x
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Places of decoded secrets."""
        out, whole = [], None
        for tokens, free, before, after in stretches(text):
            if not any(free):
                continue
            whole = whole or file_features(text)
            rows = [features(tokens, before, after, whole, i) if f else [] for i, f in enumerate(free)]
            start = None
            for (_, a, b), tag in zip([*tokens, ("", 0, 0)], [*self.viterbi(self.emissions(rows, free)), O], strict=True):
                if start is not None and tag != 1:
                    out.append((start, end))
                    start = None
                if tag == 0:
                    start = a
                end = b
        return out


@cache
def trained() -> Field:
    """The field, by conditional likelihood with an L2 penalty (Adam, all examples in each round)."""
    r, index, chains = random.Random(SEED), {}, []
    for _ in range(EXAMPLES):
        text, spans = generated_file(r)
        whole = file_features(text)
        for tokens, free, before, after in stretches(text):
            if any(free):
                tags, inside = [], None
                for (_, a, b), ok in zip(tokens, free, strict=True):
                    hit = next((s for s in spans if s[0] <= a and b <= s[1]), None) if ok else None
                    tags.append(O if hit is None else 1 if hit == inside else 0)
                    inside = hit
                rows = [[index.setdefault(f, len(index)) for f in features(tokens, before, after, whole, i)] if ok else [] for i, ok in enumerate(free)]
                chains.append((rows, free, tags))
    n, steps, wide = len(chains), max(len(t) for _, _, t in chains), max(len(x) for rows, *_ in chains for x in rows)
    pad = len(index)
    ids, tags, free, live = np.full((n, steps, wide), pad), np.full((n, steps), O), np.zeros((n, steps), bool), np.zeros((n, steps), bool)
    for k, (rows, ok, t) in enumerate(chains):
        live[k, : len(t)], tags[k, : len(t)], free[k, : len(t)] = True, t, ok
        for i, x in enumerate(rows):
            ids[k, i, : len(x)] = x
    weights, moves = np.zeros((pad + 1, 3)), np.zeros((3, 3))
    closed = np.zeros((3, 3))
    closed[O, 1] = -1e9
    gold = np.zeros((pad + 1, 3))
    at = np.nonzero(free)
    for c in range(3):
        gold[:, c] = np.bincount(ids[at][tags[at] == c].ravel(), minlength=pad + 1)
    pairs = live[:, 1:] & live[:, :-1]
    gold_moves = np.bincount((tags[:, :-1] * 3 + tags[:, 1:])[pairs], minlength=9).reshape(3, 3)
    flat, owner = ids[at], np.repeat(np.arange(len(at[0])), wide)
    m, v, mm, vm = np.zeros_like(weights), np.zeros_like(weights), np.zeros((3, 3)), np.zeros((3, 3))
    norm = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for step in range(1, ROUNDS + 1):
        weights[pad] = 0
        e = np.zeros((n, steps, 3))
        e[..., :O] = -1e9
        e[at] = weights[flat].sum(1)
        go = moves + closed
        a, b = np.zeros((n, steps, 3)), np.zeros((n, steps, 3))
        a[:, 0] = e[:, 0] + np.array([0, -1e9, 0])
        for i in range(1, steps):
            a[:, i] = np.where(live[:, i, None], norm(a[:, i - 1, :, None] + go, 1) + e[:, i], a[:, i - 1])
        for i in range(steps - 2, -1, -1):
            b[:, i] = np.where(live[:, i + 1, None], norm(go + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
        z = norm(a[:, -1], 1)
        p = np.exp(np.minimum(0, a + b - z[:, None, None]))[at]
        grad = np.stack([np.bincount(flat.ravel(), p[owner, c], pad + 1) for c in range(3)], 1) - gold + 0.05 * weights
        edge = np.exp(np.minimum(0, a[:, :-1, :, None] + go + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]))
        grad_moves = edge[pairs].sum(0) - gold_moves + 0.05 * moves
        for w, g, first, second in ((weights, grad, m, v), (moves, grad_moves, mm, vm)):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    kept = np.abs(weights[:pad]).max(1) > 1e-3
    names = [f for f, k in index.items() if kept[k]]
    return Field({f: i for i, f in enumerate(names)}, weights[[index[f] for f in names]].copy(), moves + closed)


def scan(text: str, field: Field) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans; and all spans with the field's, as far as they do not overlap base ones."""
    base = base_spans(text)
    found = field.spans(text)
    extra = [(a, "crf", b) for (a, b), ok in zip(found, apart(found, [(a, b) for a, _, b in base]), strict=True) if ok]
    order = (*KINDS, "crf")
    return base, sorted([*base, *extra], key=lambda s: (s[0], order.index(s[1])))


class _Scan:
    def __init__(self, field: Field) -> None:
        self.field = field

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t, self.field) for t in texts(batch)]
        printed = [[",".join(f"{k}:{a}:{b}" for a, k, b in part) for part in row] for row in rows]
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
        digest = pa.array([hashlib.sha256(base.encode()).hexdigest() for base, _ in printed])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([x for _, x in printed], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs (columns doc_id, text; others are ignored).

    Null text is empty: counts 0, the digest of the empty string, no spans. spans lists kind:start:end in code points, by start and
    then kind; the field's spans have kind crf and never overlap base ones. Repeated rows are judged alike. Texts are scanned whole, in time
    in proportion to their length. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), _Scan(trained()), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
