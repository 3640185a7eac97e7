"""Secrets in texts: patterns, and a linear-chain conditional random field that adds what they miss.

A text is a chain of tokens (runs of letters, digits and ``_-+/``; any other sign that is no blank by itself), each tagged as begin of a secret, inside or
outside. Features are the token's shape (length, kinds of signs, changes between kinds, how unlike running text its pairs of
signs are), the neighbouring words and signs, and the file (its share of code punctuation and of digits). The best tags are found by Viterbi
over blocks of tokens in step: products of the blocks' transitions first, then the scores from block to block, then the tags within the blocks.

The field is trained on a bounded sample of windows of the corpus. Labels are the findings of the patterns in them, and secrets of
many formats, and things that look like secrets but are none, put between their words by a seeded generator.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ship, slices
from strandline.llm.words import hash_words, text_bytes

#: Windows (of so many code points) that the field is trained on, one a document, of the smallest hashes; passes over them.
FIT_WINDOWS, WINDOW, EPOCHS = 2_000, 400, 10
#: Code points of the shortest secret that the field may add.
LEAST = 8
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Tokens of a block of the Viterbi pass.
BLOCK = 64
_NEVER = -1e9

# The kinds of findings, in the order of equal starts; and the patterns.
KINDS = ("assign", "access", "hex", "field")
_either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_ASSIGN = re.compile(
    f"({_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are whole, so shorter ones are no part of longer ones
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

# Kinds of bytes: blank, sign, then those of words: lower, upper, digit, joiner, non-ASCII.
_KIND = np.full(256, 1, np.uint8)
_KIND[: 0x21] = 0
_KIND[0x7F] = 0
_KIND[[ord(c) for c in string.ascii_lowercase]] = 2
_KIND[[ord(c) for c in string.ascii_uppercase]] = 3
_KIND[[ord(c) for c in string.digits]] = 4
_KIND[[ord(c) for c in "_-+/"]] = 5
_KIND[0x80:] = 6
_IN_WORD = _KIND >= 2
# Signs by role: quotes, assigning signs, brackets, others.
_ROLE = np.full(256, 4, np.int64)
_ROLE[[ord(c) for c in "\"'`"]] = 1
_ROLE[[ord("="), ord(":")]] = 2
_ROLE[[ord(c) for c in "()[]{}<>"]] = 3
_ROLE[_IN_WORD] = 5
_CODE = np.isin(np.arange(256), [ord(c) for c in "={}[]<>;()_\"#$|\\"])
# Symbols of pairs: letters without case, digit, joiner, non-ASCII by its low bits.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in string.ascii_lowercase]] = np.arange(1, 27)
_SYMBOL[[ord(c) for c in string.ascii_uppercase]] = np.arange(1, 27)
_SYMBOL[[ord(c) for c in string.digits]] = 27
_SYMBOL[[ord(c) for c in "_-+/"]] = 28
_SYMBOL[0x80:] = 29 + (np.arange(128) >> 6)
_SYMBOLS = 32
_WORDS = 4096
#: Number of values of each feature.
SIZES = (16, 128, 32, 32, _WORDS + 1, 36, 48, 12, 96, 33, 33)


def base_spans(text: str, hex_runs: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' findings: leftmost non-overlapping matches of each kind; too short ones are dropped."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if hex_runs:
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


@dataclass(frozen=True)
class Tokens:
    """Tokens of many texts in a row: their bytes, and the number of each text's first token (one more entry at the end)."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def tokens(column: pa.Array) -> tuple[Tokens, np.ndarray]:
    """(tokens, offsets of the texts' bytes)."""
    raw, offsets = text_bytes(column)
    kind = _KIND[raw]
    word = kind >= 2
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts, ends = kind == 1, kind == 1
    if len(raw):
        starts |= word & ~np.concatenate([[False], word[:-1] & ~edge[1:-1]])
        ends = ends | word & ~np.concatenate([word[1:] & ~edge[1:-1], [False]])
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Tokens(raw, starts, ends, np.searchsorted(starts, offsets)), offsets


def file_values(t: Tokens, offsets: np.ndarray) -> np.ndarray:
    """The file feature of each text: shares of code punctuation and of digits, in steps."""
    size = np.maximum(np.diff(offsets), 1)
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]) / size
    return np.digitize(share(_CODE[t.raw]), [0.005, 0.02, 0.06]) * 3 + np.digitize(share(_KIND[t.raw] == 4), [0.01, 0.06])


def features(t: Tokens, file: np.ndarray, surprise: np.ndarray) -> np.ndarray:
    """Values [feature, token] by ``SIZES``. ``surprise`` [symbol, symbol]: sixteenths of bits a pair of signs costs in running text."""
    raw, n = t.raw, len(t.starts)
    length = t.ends - t.starts
    kind = _KIND[raw]
    has = np.zeros(n, np.int64)
    if n:
        within = np.minimum(np.bitwise_or.reduceat(np.append(1 << kind.astype(np.int64), 0), np.stack([t.starts, t.ends], 1).reshape(-1))[::2], 127)
        has = (within >> 2) & 31
    before = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    change, cost = np.zeros(len(raw), np.int8), np.zeros(len(raw), np.int16)
    if len(raw) > 1:
        change[1:] = kind[1:] != kind[:-1]
        symbol = _SYMBOL[raw]
        cost[1:] = surprise[symbol[:-1] * _SYMBOLS + symbol[1:]]
    summed = lambda x: (lambda c: c[t.ends] - c[np.minimum(t.starts + 1, t.ends)])(before(x))
    changes, mean = summed(change), summed(cost) / np.maximum(length - 1, 1) / 16
    coarse = np.digitize(length, [6, 12, 24])
    odd = np.digitize(mean, [4.0, 4.6, 5.2, 5.8, 6.4, 7.0, 7.8])
    odd[length < 4] = 0
    owner = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    begin = t.first[owner]
    at = np.arange(n)
    role = _ROLE[raw[t.starts]] if n else np.zeros(0, np.int64)
    inner = np.zeros(n, bool)
    inner[1:] = begin[1:] != at[1:]
    previous, following = np.zeros(n, np.int64), np.zeros(n, np.int64)
    previous[1:] = np.where(inner[1:], role[:-1], 0)
    following[:-1] = np.where(inner[1:], role[1:], 0)
    # The nearest word before, of the same text.
    is_word = role == 5
    last = np.maximum.accumulate(np.where(is_word, at, -1))
    word_before = np.concatenate([[-1], last[:-1]]) if n else last
    known = word_before >= begin
    hashed = (hash_words(raw, t.starts, t.ends) & np.uint64(_WORDS - 1)).astype(np.int64)
    neighbour = np.where(known & (at - word_before <= 5), hashed[word_before], _WORDS)
    shape = odd * 4 + coarse
    beside_before, beside_after = np.full(n, 32), np.full(n, 32)
    beside_before[1:] = np.where(inner[1:], shape[:-1], 32)
    beside_after[:-1] = np.where(inner[1:], shape[1:], 32)
    of_file = file[owner]
    values = (
        np.digitize(length, [2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 128]), has * 4 + coarse, np.minimum(changes, 7) * 4 + coarse, shape, neighbour,
        previous * 6 + following, odd * 6 + previous, of_file, of_file * 8 + odd, beside_before, beside_after,
    )
    return np.stack(values)


@dataclass(frozen=True)
class Field:
    """Scores: a table [value, tag] per feature, transitions [tag, tag], first tags; and the costs of pairs of signs."""

    tables: list[np.ndarray]
    steps: np.ndarray
    first: np.ndarray
    surprise: np.ndarray

    def scores(self, values: np.ndarray) -> np.ndarray:
        """[tag, token]."""
        out = np.zeros((values.shape[1], 3))
        for table, v in zip(self.tables, values):
            out += table[v]
        return out.T

    def tags(self, t: Tokens, file: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(t.starts), bool)
        begins[t.first[:-1][np.diff(t.first) > 0]] = True
        return viterbi(self.scores(features(t, file, self.surprise)), self.steps, self.first, begins)


def viterbi(score: np.ndarray, steps: np.ndarray, first: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The tags of the best path over ``score`` [tag, token]; at ``begins`` the tag before doesn't matter and ``first`` stands for the step."""
    k, n = score.shape
    if n == 0:
        return np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    e = np.zeros((k, blocks * BLOCK))
    e[:, :n] = score
    e = np.ascontiguousarray(e.reshape(k, blocks, BLOCK).transpose(2, 0, 1))
    new = np.ones(blocks * BLOCK, bool)  # what fills the last block up is a chain of its own
    new[:n] = begins
    new = np.ascontiguousarray(new.reshape(blocks, BLOCK).T)
    step = lambda t, i, j: np.where(new[t], first[j], steps[i, j])
    whole = np.where(np.eye(k, dtype=bool)[:, :, None], 0.0, _NEVER) + np.zeros(blocks)
    for t in range(BLOCK):
        moves = [[step(t, i, j) for j in range(k)] for i in range(k)]
        whole = np.stack([np.stack([np.max([whole[a, i] + moves[i][j] for i in range(k)], 0) + e[t, j] for j in range(k)]) for a in range(k)])
    entry, v = np.zeros((k, blocks)), np.zeros(k)
    for b in range(blocks):
        entry[:, b] = v
        v = (v[:, None] + whole[:, :, b]).max(0)
        v = v - v.max()
    back = np.zeros((BLOCK, k, blocks), np.int8)
    at = entry
    for t in range(BLOCK):
        to = []
        for j in range(k):
            ways = np.stack([at[i] + step(t, i, j) for i in range(k)])
            back[t, j] = ways.argmax(0)
            to.append(ways.max(0) + e[t, j])
        at = np.stack(to)
    # Where each last tag of a block comes from, then the blocks' last tags from the end, then the tags within.
    came, column = np.repeat(np.arange(k)[:, None], blocks, 1), np.arange(blocks)
    for t in range(BLOCK - 1, -1, -1):
        came = np.stack([back[t, came[j], column] for j in range(k)])
    ends, tag = np.zeros(blocks, np.int64), int(at[:, -1].argmax())
    for b in range(blocks - 1, -1, -1):
        ends[b] = tag
        tag = int(came[tag, b])
    out = np.zeros((BLOCK, blocks), np.int64)
    now = ends
    for t in range(BLOCK - 1, -1, -1):
        out[t] = now
        now = back[t, now, column]
    return out.T.reshape(-1)[:n]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def expectations(score: np.ndarray, steps: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of tags [chain, place, tag] and the sum of those of steps [tag, tag], over chains padded to one length."""
    chains, longest, k = score.shape
    inside = np.arange(longest)[None] < n[:, None]
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = first + score[:, 0]
    for t in range(1, longest):
        alpha[:, t] = np.where(inside[:, t, None], _logsum(alpha[:, t - 1, :, None] + steps, 1) + score[:, t], alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        beta[:, t] = np.where(inside[:, t + 1, None], _logsum(steps + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
    z = _logsum(alpha[:, -1], 1)
    tag = np.exp(alpha + beta - z[:, None, None]) * inside[:, :, None]
    pair = np.exp(alpha[:, :-1, :, None] + steps + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
    return tag, (pair * inside[:, 1:, None, None]).sum((0, 1))


# Names that secrets are given by, and words that follow such a name where none is given.
_NAMES = "password passwd secret token api_key apikey pwd auth key credential client_secret access_key private_key bearer authorization session_key db_password".split()
_PLAIN = "policy required reset expired field holder manager economy ring bearer missing invalid optional string".split()
_JOINS = ('="', ' = "', "=", " = ", ": ", ':"', ': "', " ", " : ", "='")


def random_secret(rng: random.Random) -> str:
    """A value of one of the formats that secrets come in."""
    some = lambda signs, low, high: "".join(rng.choice(signs) for _ in range(rng.randint(low, high)))
    mixed = string.ascii_letters + string.digits
    kind = rng.randrange(8)
    if kind == 0:
        return some(string.digits + "abcdef", 20, 64)
    if kind == 1:
        return some(string.digits + "ABCDEF", 20, 64)
    if kind == 2:
        return some(mixed + "+/", 20, 64) + "=" * rng.randrange(3)
    if kind == 3:
        return some(string.ascii_lowercase, 2, 4) + rng.choice("_-") + some(mixed, 16, 40)
    if kind == 4:
        return some(string.ascii_uppercase, 4, 4) + some(string.ascii_uppercase + string.digits, 12, 24)
    if kind == 5:
        return ".".join(some(mixed + "_-", 12, 36) for _ in range(3))
    if kind == 6:
        return some(mixed, 5, 9) + rng.choice("!@#$%&*") + some(mixed + "!@#$%", 3, 8)
    return "-".join(some(string.digits + "abcdef", m, m) for m in (8, 4, 4, 4, 12))


def _lookalike(rng: random.Random, words: list[str]) -> str:
    """Something that is no secret."""
    word = lambda: rng.choice(words)
    number = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    kind = rng.randrange(11)
    return (
        f"{word()}{rng.choice('.,!#*%&$') * rng.randint(2, 5)} {word()}{rng.choice('.,!#*%&$') * rng.randint(1, 4)}", f"{word()}'{word()}{rng.choice('!#*%&$@')}{word()}",
        f"{rng.choice(_NAMES)} {rng.choice(_PLAIN)}", f"{rng.choice(_NAMES)}: {word()} {word()}", number(rng.randint(5, 18)), f"https://www.{word()}.com/{word()}/{word()}-{word()}?id={number(4)}",
        f"/usr/{word()}/{word()}_{word()}.py", f"{word()}.{word()}@{word()}.org", f"{number(4)}-{number(2)}-{number(2)}", f"+1 ({number(3)}) {number(3)}-{number(4)}", f"{word()}{word()}{word()}",
    )[kind]


def _labelled(window: str, rng: random.Random, words: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """A window with what was put in, and the places of all secrets."""
    blanks = [m.start() for m in re.finditer(r"\s", window)]
    at = rng.choice(blanks) + 1 if blanks else 0
    kind = rng.random()
    if kind < 0.25:
        return window, [_value(s, window) for s in base_spans(window)]
    if kind < 0.55:
        added, inner = _lookalike(rng, words), None
    else:
        value = random_secret(rng)
        name = rng.choice(_NAMES)
        name = rng.choice([name, name, name.upper(), name.title(), f"{rng.choice(words)}_{name}"])
        join = rng.choice(_JOINS)
        before = name + join if rng.random() < 0.85 else rng.choice(['"', "", "("])
        added, inner = before + value + (join[-1] if join[-1] in "\"'" else ""), (len(before), len(before) + len(value))
    text = f"{window[:at]}{added} {window[at:]}"
    spans = [_value(s, text) for s in base_spans(text)]
    if inner:
        spans.append((at + inner[0], at + inner[1]))
    return text, spans


def _value(span: tuple[str, int, int], text: str) -> tuple[int, int]:
    """The secret itself: of an assignment the value alone."""
    kind, start, end = span
    return _ASSIGN.match(text, start).span(2) if kind == "assign" else (start, end)


def train(windows: list[str], seed: int = 17, epochs: int = EPOCHS) -> Field:
    """The field of largest likelihood, with a quadratic penalty, by Adam over batches of windows in seeded order."""
    rng = random.Random(seed)
    windows = sorted({w for w in windows if w.strip()}) or ["a text without anything to learn from"]
    words = sorted({w for x in windows for w in re.findall(r"[^\W\d_]{3,}", x)}) or ["word"]
    pairs = np.ones((_SYMBOLS, _SYMBOLS))
    for w in windows:
        for s in base_spans(w)[::-1]:
            w = w[: s[1]] + w[s[2] :]
        symbol = _SYMBOL[np.frombuffer(w.encode(), np.uint8)]
        both = (symbol[:-1] > 0) & (symbol[1:] > 0)
        np.add.at(pairs, (symbol[:-1][both], symbol[1:][both]), 1)
    # Surprise by the pair's share among all pairs, so rare signs such as digits are dear as well.
    surprise = np.clip(-16 * np.log2(pairs / pairs.sum()) / 2, 0, 255).astype(np.int16).reshape(-1)

    labelled = [_labelled(w, rng, words) for w in windows for _ in range(2)]
    origin, places = tokens(pa.array([w for w in windows for _ in range(2)], pa.string()))
    file = file_values(origin, places)
    t, offsets = tokens(pa.array([x for x, _ in labelled], pa.string()))
    values, tag = features(t, file, surprise), np.zeros(len(t.starts), np.int64)
    for i, (text, spans) in enumerate(labelled):
        for a, b in spans:
            a, b = (offsets[i] + len(text[:p].encode()) for p in (a, b))
            low, high = np.searchsorted(t.ends, a, "right"), np.searchsorted(t.starts, b, "left")
            if high > low:
                tag[low + 1 : high] = INSIDE
                tag[low] = BEGIN
    size = np.diff(t.first)
    tables, steps, first = [np.zeros((s, 3)) for s in SIZES], np.zeros((3, 3)), np.zeros(3)
    barred = np.zeros((3, 3))
    barred[OUTSIDE, INSIDE] = _NEVER
    entering = np.array([0.0, 0.0, _NEVER])
    weights = [*tables, steps, first]
    moment, square, turn = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    order = sorted(np.flatnonzero(size).tolist(), key=lambda i: size[i])
    batches = [order[i : i + 128] for i in range(0, len(order), 128)]
    for _ in range(epochs):
        rng.shuffle(batches)
        for batch in batches:
            n, longest = size[batch], int(size[batch].max())
            place = np.minimum(t.first[batch][:, None] + np.arange(longest), len(tag) - 1)
            inside = np.arange(longest) < n[:, None]
            score = sum(w[v[place]] for w, v in zip(tables, values))
            p, pair = expectations(score, steps + barred, first + entering, n)
            truth = np.eye(3)[tag[place]] * inside[:, :, None]
            excess, flat = (p - truth)[inside], place[inside]
            grads = [np.stack([np.bincount(v[flat], excess[:, j], len(w)) for j in range(3)], 1) for w, v in zip(tables, values)]
            moved = inside[:, 1:]
            real = np.bincount((tag[place[:, :-1]] * 3 + tag[place[:, 1:]])[moved], minlength=9).reshape(3, 3)
            grads += [pair - real, (p[:, 0] - truth[:, 0]).sum(0)]
            turn += 1
            for w, g, m, q in zip(weights, grads, moment, square):
                g = g / len(batch) + 1e-4 * w
                m += 0.1 * (g - m)
                q += 0.01 * (g * g - q)
                w -= 0.05 * (m / (1 - 0.9**turn)) / (np.sqrt(q / (1 - 0.99**turn)) + 1e-8)
    return Field(tables, steps + barred, first + entering, surprise)


def fit(docs: DataFrame, windows: int = FIT_WINDOWS, text: str = "text") -> Field:
    """A field trained on one window of each of at most ``windows`` documents, those of the smallest hashes of id and text among every nth hash,
    where n leaves about four times as many: so a task hands on few windows, however many tasks there are."""
    every = docs.count() // (4 * windows) + 1
    hashed = docs.where(F.length(text) > 0).select(F.xxhash64("doc_id", text).alias("h"), F.col(text).alias("text"))
    keyed = hashed.where(F.pmod("h", F.lit(every)) == 0).withColumn("h", F.xxhash64("h"))
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    rows = keyed.select("h", F.substring("text", (F.pmod(F.col("h"), room) + 1).cast("int"), F.lit(WINDOW)).alias("window")).orderBy("h", "window").limit(windows)
    return train([r.window for r in rows.collect()])


def find_secrets(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points by start, then kind, of every row of ``docs``.

    The patterns' findings are all there; the field adds its own (kind ``field``) of at least ``LEAST`` code points where they overlap none of those. Null and empty texts have no spans. Whole texts are read; rows
    are never exchanged, repeated rows and null ids stay. Other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in all_spans(b.column("text"), shared.value)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, span_type)], ["doc_id", "spans"])

    rows = docs.select("doc_id", F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def all_spans(column: pa.Array, field: Field) -> list[list[tuple[str, int, int]]]:
    """The sorted spans of each text of an Arrow column."""
    t, offsets = tokens(column)
    added, runs, out = _added(field, t, offsets), _hex_rows(t.raw, offsets), []
    for i, value in enumerate(column.to_pylist()):
        base = base_spans(value, i in runs) if value else []
        more = [("field", a, z) for a, z in added.get(i, ()) if all(z <= s or a >= e for _, s, e in base)]
        out.append(sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]))))
    return out


def _hex_rows(raw: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Texts that may hold a run of 32 hexadecimal digits: every 16th byte of one is such a digit, twice in a row."""
    every = raw[::16]
    some = ((every >= 48) & (every <= 57)) | ((every >= 97) & (every <= 102))
    return set((np.searchsorted(offsets, np.flatnonzero(some[1:] & some[:-1]) * 16 + 16, "right") - 1).tolist())


def _added(field: Field, t: Tokens, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """The field's findings by text, in code points."""
    tag = field.tags(t, file_values(t, offsets))
    begin = np.flatnonzero(tag == BEGIN)
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(begin):
        return out
    other = np.append(np.flatnonzero(tag != INSIDE), len(tag))
    last = other[np.searchsorted(other, begin, "right")] - 1
    owner = np.searchsorted(t.first, begin, "right") - 1
    last = np.minimum(last, t.first[owner + 1] - 1)
    points = np.concatenate([[0], np.cumsum((t.raw & 0xC0) != 0x80)])
    low, high = (points[x] - points[offsets[owner]] for x in (t.starts[begin], t.ends[last]))
    for i, a, z in zip(owner.tolist(), low.tolist(), high.tolist()):
        if z - a >= LEAST:
            out.setdefault(i, []).append((a, z))
    return out


def redact(docs: DataFrame, field: Field, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs``, all columns, with every span of its texts replaced by ``mark``; overlapping spans are one. Null texts stay null."""
    ship(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, f"c{place}"):
            done = []
            for value, spans in zip(b.column(place).to_pylist(), all_spans(b.column(place), shared.value)):
                parts, at = [], 0
                for _, start, end in spans:
                    if start >= at:
                        parts += [value[at:start], mark]
                    at = max(at, end)
                done.append(value if value is None else "".join(parts) + value[at:])
            yield b.set_column(place, b.schema.field(place), pa.array(done, b.schema.field(place).type))

    # Columns are renamed by place, as names may be repeated.
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, schema).toDF(*docs.columns)
