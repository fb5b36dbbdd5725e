"""Language identification by cross-parsing entropy.

Method
    For each language a suffix automaton of labelled text is built. A text is parsed from left to right: each phrase is
    the longest match that the automaton follows, then the next begins. Fewer phrases mean that the text is made
    of that language's strings; phrases are normalised by the text's length and the automaton's log size, and the
    language with the fewest wins. Texts are whole. Their lanes of LANE characters are parsed side by side; then each lane is begun
    again in the state in which the one before it ended, until both parses are in the same state, so that phrases run over lanes' ends.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import kept, map_batches, prepare

#: The bound of the labelled sample: SAMPLE_PIECES pieces of PIECE characters for each language, SAMPLE_ALL of all languages together, so
#: that all automata stay below some 150 MB in a worker. With more than SAMPLE_ALL languages, each has one shorter piece.
SAMPLE_PIECES, PIECE, SAMPLE_ALL = 160, 200, 1280
LANE = 512
#: Lanes that are parsed side by side.
LANES = 4096
#: The automaton of a sample of more symbols than this has its transitions by key instead of in a table.
DENSE = 64
_FLAG = 1 << 30
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """The lower-case code point of each letter, and 0 of what is not a letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                table[c] = ord(low) if len(low := x.lower()) == 1 else c
        _letters.append(table)
    return _letters[0]


def folded(text: str) -> np.ndarray:
    """Code points with letters in lower case; a run of other characters is one 0."""
    x = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return x[(x != 0) | np.r_[True, x[:-1] != 0]] if len(x) else x


def suffix_automaton(codes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a sequence: its number of states, and from, symbol and to of all transitions; 0 is the root."""
    to: list[dict[int, int]] = [{}]
    link, longest = array("i", [-1]), array("i", [0])
    last = 0
    for c in codes.tolist():
        cur = len(longest)
        to.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if longest[q] == longest[p] + 1:
                link[cur] = q
            else:
                copy = len(longest)
                to.append(dict(to[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    sizes = np.fromiter(map(len, to), np.int64, len(to))
    n = int(sizes.sum())
    return len(to), np.repeat(np.arange(len(to)), sizes), np.fromiter((c for t in to for c in t), np.int64, n), np.fromiter((q for t in to for q in t.values()), np.int64, n)


class _Automaton:
    """One language's automaton. Each symbol of its sample has a class; the others share the last one, which no transition has."""

    def __init__(self, codes: np.ndarray, symbols: int) -> None:
        own = np.unique(codes)
        self.classes = np.full(symbols, len(own), np.int16 if len(own) < 1 << 15 else np.int32)
        self.classes[own] = np.arange(len(own))
        self.width = len(own) + 1
        n, at, c, to = suffix_automaton(self.classes[codes])
        self.start = np.zeros(self.width, np.int32)  # after a phrase's end its last character begins the next
        self.start[c[at == 0]] = to[at == 0]
        self.dense = self.width <= DENSE
        if self.dense:
            full = np.tile((self.start * self.width) | _FLAG, (n, 1))
            full[at, c] = to * self.width
            self.table = full.astype(np.int32).ravel()
        else:
            keys = at * self.width + c
            order = np.argsort(keys)
            self.keys, self.to = keys[order], to[order].astype(np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one symbol each (its class), and 1 where a phrase ended before it."""
        if self.dense:
            got = self.table.take(state + c)
            return got & (_FLAG - 1), got >> 30
        ended = np.ones(len(c), np.int32)
        now = self.start.take(c)
        known = np.flatnonzero(c < self.width - 1)  # a symbol that the sample lacks ends a phrase anyway
        key = state[known].astype(np.int64) * self.width + c[known]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[k] == key
        ended[known[hit]] = 0
        now[known[hit]] = self.to[k[hit]]
        return now, ended

    def parse(self, lanes: np.ndarray, sizes: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Ends of phrases in each lane of symbols, of which the first sizes[i] count; goes_on: the text of the lane before goes on in this one."""
        ends, last = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int32)
        for a in range(0, len(lanes), LANES):
            order = a + np.argsort(-sizes[a : a + LANES], kind="stable")
            steps = self.classes.take(np.ascontiguousarray(lanes[order].T))
            alive = np.searchsorted(-sizes[order], -np.arange(lanes.shape[1]), "left")
            state, count = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
            for t in range(len(steps)):
                if not (m := alive[t]):
                    break
                state[:m], ended = self.step(state[:m], steps[t, :m])
                count[:m] += ended
            ends[order], last[order] = count, state
        # each lane was begun at the root; a lane that goes on begins where the one before it ended
        begun = np.zeros(len(lanes), np.int32)
        again = np.flatnonzero(goes_on)
        while len(again):
            again = again[begun[again] != last[again - 1]]
            changed = []
            for a in range(0, len(again), LANES):
                own = again[a : a + LANES]
                old, new = begun[own].copy(), last[own - 1].copy()
                begun[own] = new
                t, stop = 0, 0
                while len(own):
                    if t >= stop:
                        over = sizes[own] <= t
                        if over.any():  # the lane ended before the parses met
                            last[own[over]] = new[over]
                            changed.append(own[over])
                            own, old, new = own[~over], old[~over], new[~over]
                        stop = sizes[own].min(initial=lanes.shape[1])
                        continue
                    c = self.classes.take(lanes[own, t])
                    old, less = self.step(old, c)
                    new, more = self.step(new, c)
                    ends[own] += more - less
                    t += 1
                    apart = np.flatnonzero(old != new)
                    if len(apart) < len(own):
                        own, old, new = own[apart], old[apart], new[apart]
            after = np.concatenate(changed) + 1 if changed else np.zeros(0, np.int64)
            after = after[after < len(lanes)]
            again = np.unique(after[goes_on[after]])
        return ends


class CrossParser:
    """Parses texts against the automata of all languages at once."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        text = {k: folded(samples[k]) for k in self.names}
        seen = np.unique(np.concatenate([np.zeros(1, np.uint32), *text.values()]))
        # each letter of the samples is a symbol of its own, 0 is what is no letter; the two last ones are all other letters, and a lane's filling
        self.other, self.pad = len(seen), len(seen) + 1
        self.kind = np.uint16 if self.pad < 1 << 16 else np.int32
        self.classes = np.full(0x110000, self.other, self.kind)
        self.classes[seen] = np.arange(len(seen))
        self.automata = [_Automaton(self.classes[text[k]], self.pad + 1) for k in self.names]
        self.weight = np.array([np.log2(max(2, len(text[k]))) for k in self.names])

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases [texts, languages], and whether a text has a letter."""
        lanes, owner, sizes = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            x = folded(t) if t else None
            if x is None or not x.any():
                continue
            c = self.classes[x]
            sizes[i] = len(c)
            n = -(-len(c) // LANE)
            wide = np.full(n * LANE, self.pad, self.kind)
            wide[: len(c)] = c
            lanes.append(wide.reshape(n, LANE))
            owner.append(np.full(n, i))
        found = np.zeros((len(texts), len(self.names)))
        if lanes and self.names:
            which, codes = np.concatenate(owner), np.concatenate(lanes)
            goes_on = np.r_[False, which[1:] == which[:-1]]
            used = (codes != self.pad).sum(1)
            for k, own in enumerate(self.automata):
                found[:, k] = np.bincount(which, own.parse(codes, used, goes_on), len(texts))
            found[sizes > 0] += 1  # the last phrase of each text
        return found * self.weight / np.maximum(1, sizes)[:, None], sizes > 0


def learn(docs: DataFrame) -> dict[str, str]:
    """A bounded sample of labelled text for each language: a text of the sample's pieces, by language.

    Pieces are places in the distinct labelled texts of a language, drawn by a hash of text and number; copies of a text are one. A language
    with few texts gives several pieces of each. All of it is done in the cluster; the driver gets the pieces alone.
    """
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & F.col("text").rlike("\\p{L}"))
    known = known.select("lang", "text", F.xxhash64("text").alias("hash"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()}
    if not counts:
        return {}
    most, chars = max(1, min(SAMPLE_PIECES, SAMPLE_ALL // len(counts))), max(1, min(PIECE, PIECE * SAMPLE_ALL // len(counts)))
    of = lambda values, kind: F.try_element_at(F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>"), F.col("lang"))
    # three times as many texts as are wanted pass, if there are so many; the window below keeps the first ones
    share = of({k: min(1.0, 3 * most / max(1, n)) if n > 4 * most else 1.0 for k, n in counts.items()}, "double")
    each = of({k: -(-2 * most // max(1, n)) for k, n in counts.items()}, "int")
    lettered = lambda rows: rows.where(F.col("piece").rlike("\\p{L}")).groupBy("lang", "rank").agg(F.first("piece").alias("piece"))
    rows = known.where((F.col("hash").bitwiseAND(16777215)) < share * 16777216).withColumn("number", F.explode(F.sequence(F.lit(1), each)))
    place = F.pmod(F.xxhash64("hash", "number"), F.greatest(F.ceil(F.char_length("text") / chars), F.lit(1)))
    rows = lettered(rows.select("lang", F.xxhash64("hash", place).alias("rank"), F.expr("text").substr((place * chars + 1).cast("int"), F.lit(chars)).alias("piece")))
    first = Window.partitionBy("lang").orderBy("rank")
    found = rows.withColumn("n", F.row_number().over(first)).where(f"n <= {most}").select("lang", "n", "piece").collect()  # SAMPLE_ALL pieces at most
    if left := sorted(set(counts) - {r["lang"] for r in found}):
        # where no piece that was drawn has a letter: the text of the smallest hash from its first letter on
        begin = F.regexp_instr("text", F.lit("\\p{L}"))
        one = known.where(F.col("lang").isin(left)).groupBy("lang").agg(F.min_by(F.expr("text").substr(begin, F.lit(chars)), "hash").alias("piece"))
        found += one.select("lang", F.lit(1).alias("n"), "piece").collect()
    out: dict[str, list[str]] = {}
    for lang, _, piece in sorted(found):
        out.setdefault(lang, []).append(piece)
    return {k: " ".join(v) for k, v in out.items()}


def parser(samples: dict[str, str]) -> CrossParser:
    return kept(("language", zlib.crc32(repr(sorted(samples.items())).encode("utf-8", "surrogatepass"))), lambda: CrossParser(samples))


class _Predict:
    def __init__(self, samples: dict[str, str]) -> None:
        self.samples = samples

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        rates, letters = parser(self.samples).rates(batch.column("text").to_pylist())
        names = parser(self.samples).names
        if not names:
            best, score, least = [None] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        else:
            safe = np.maximum(rates, 1e-9)
            power = (safe.min(1, keepdims=True) / safe) ** 4
            best = [names[i] for i in safe.argmin(1)]
            score, least = 1 / power.sum(1), safe.min(1)
        lang = [b if ok and b is not None else "und" for b, ok in zip(best, letters, strict=True)]
        hit = np.array([x != "und" for x in lang])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(lang), pa.array(np.where(hit, score, 0.0)), pa.array(np.where(hit, least, 0.0))], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "phrase_rate"])


class _Accept:
    def __init__(self, samples: dict[str, str], languages: list[str] | None) -> None:
        self.samples, self.languages = samples, languages

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        own = parser(self.samples)
        rates, ok = own.rates(texts := batch.column("text").to_pylist())
        if rates.shape[1]:
            # a few phrases say nothing: a short text may have FREE_PHRASES more
            free = FREE_PHRASES * own.weight.max() / np.array([max(1, len(t or "")) for t in texts])
            ok &= rates.min(1) <= MOST_RATE + free
            if self.languages is not None:
                ok &= np.isin(np.array(own.names), self.languages)[rates.argmin(1)]
        return batch.filter(pa.array(ok))


#: Normalised phrases for each character beyond which a text is in none of the learned languages. Texts of a learned language
#: have 1 to 4 (median 2.5, highest of a hundred 3.0); strings of letters at random have 6 to 8, and a text of letters
#: that no sample has, each a phrase, the log size of an automaton, about 15.
MOST_RATE, FREE_PHRASES = 5.5, 4


def in_known_language(docs: DataFrame, samples: dict[str, str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a learned language (languages: in one of these).

    A text goes if even its nearest language needs more than MOST_RATE normalised phrases a character, and FREE_PHRASES phrases in all:
    strings at random, other scripts. Null texts and texts without letters go. Where nothing could be learned, all others stay.
    """
    prepare(docs.sparkSession)
    samples = learn(docs) if samples is None else samples
    return map_batches(docs, _Accept(samples, languages), docs.schema)


def identify(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrase_rate for each row of docs (columns doc_id, text, lang).

    held_out: crc32 of doc_id as text leaves 1 by 3; false for a null doc_id, which teaches nothing either. A text that
    is null or has no letter is 'und' with score 0, and so is every text when nothing could be learned. score is the winner's share of the
    languages' inverse phrase rates to the fourth power; ties go to the first language by name. Repeated rows are judged alike. Texts of any
    length are parsed whole, in time in proportion to it. An empty table gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    samples = learn(docs) if samples is None else samples
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("bigint"), held, "text")
    return map_batches(rows, _Predict(samples), "doc_id bigint, held_out boolean, lang_pred string, score double, phrase_rate double")
