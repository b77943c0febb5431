"""Personal data by patterns and a skip-chain conditional random field.

Fixed patterns give the base spans: e-mail and IP addresses, payment cards and phone numbers. They miss other spellings of the same
data: a phone number without its country code, a card number with dots, an address with "(at)". A linear-chain CRF labels
the tokens that could be such (those with a digit, an at sign or a substitute); tokens inside base spans are observed.
Skip edges join tokens of a document that repeat or resemble one another, however far apart: equal last digits, equal
quads, equal local parts. They share a potential, and loopy belief propagation over chain and skip edges
makes the labels of a document consistent. Runs of tokens with one label whose marginals are high enough become spans.

Weights are fitted in numpy by maximum pseudo-likelihood on generated documents, in which entities recur in several
spellings among numbers of the same shapes that are nothing of the kind; the corpus is not needed for it and the weights
are the same in every run. A group of tokens with one key is joined as a path, so edges and time are linear in the text.

Texts are scanned whole in the Arrow workers; nothing is shuffled.

Nulls and edge cases: null and empty texts have no span; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rowsieve.llm._common import map_texts, read_table

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is nothing; the others are KINDS.
LABELS = len(KINDS) + 1
#: Least marginal of every token of an added span.
CONFIDENCE = 0.9
ITERATIONS = 12

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Behind a digit no match can begin that did not begin at the run's first digit, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_AT = re.compile(r"[(\[{<](?:at|AT|At)[)\]}>]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[int, int, int]  # kind's place in KINDS, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    spans: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            spans.append((0, start, end))
        else:
            end = max(end, at + 1)  # no local part reaches over an at sign
        at = text.find("@", end)
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text) if text.count(".") > 2 else ():
        # Leading zeros may be many, and int() has a limit.
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append((3, *m.span()))
    return spans


@dataclass
class Token:
    start: int
    end: int
    text: str
    observed: int  # a label, or -1
    joined: bool  # follows the token before with nothing but white space between
    features: list[int] | None = None
    keys: tuple[str, ...] = ()


#: Words before a token that hint at its kind.
CUES = (
    {"mail", "email", "e-mail", "contact", "write"},
    {"ip", "host", "server", "address", "ping"},
    {"card", "visa", "mastercard", "payment", "account"},
    {"phone", "tel", "telephone", "call", "fax", "mobile"},
)
_SHAPES = (
    re.compile(r"[^A-Za-z]*\Z"),
    re.compile(r".*@"),
    re.compile(r".*[(\[{<](?:at|AT|At)[)\]}>]"),
    re.compile(r"\+"),
    re.compile(r"\(?\d+\)?\W*\Z"),
    re.compile(r".*\d-\d"),
    re.compile(r".*\d\.\d"),
    re.compile(r".*\d[/:]\d"),
    re.compile(r".*\d,\d"),
    re.compile(r"[$€£#]"),
    re.compile(r".*%"),
    None,  # begins with four groups of at most three digits, see _quad
    re.compile(r"\W*\d{4}-\d{2}-\d{2}|\W*\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\W*\Z"),
    re.compile(r".*[A-Za-z]"),
)
_BUCKETS = (0, 1, 4, 5, 7, 8, 10, 13, 20, 10**9)
_N = len(_BUCKETS) - 1
FEATURES = 1 + len(_SHAPES) + 2 * _N + len(CUES) + 3


def _quad(word: str) -> list[str]:
    """The first four groups of digits, if these are of three digits at most."""
    groups = [m[0] for m in itertools.islice(re.finditer("[0-9]+", word), 4)]
    return groups if len(groups) == 4 and all(len(g) <= 3 for g in groups) else []


def _bucket(n: int) -> int:
    return next(i for i in range(_N) if n < _BUCKETS[i + 1])


def tokens_of(text: str, spans: list[Span]) -> list[Token]:
    """The tokens that could be of an entity, with features and keys."""
    places = sorted((s, e, k) for k, s, e in spans)
    out: list[Token] = []
    at, last_end, before, run = 0, -1, "", ""
    for m in _TOKEN.finditer(text):
        word = m[0]
        if not (_DIGIT.search(word) or "@" in word or _AT.search(word)):
            before, last_end = word, -1
            continue
        while at < len(places) and places[at][1] <= m.start():
            at += 1
        observed = places[at][2] + 1 if at < len(places) and places[at][0] < m.end() else -1
        joined = last_end >= 0
        digits = _NOT_DIGIT.sub("", word)
        run = (run if joined else "") [-32:] + digits
        quad = _quad(word)
        features = [0, *(1 + i for i, shape in enumerate(_SHAPES) if (shape.match(word) if shape else quad))]
        base = 1 + len(_SHAPES)
        features += [base + _bucket(len(digits)), base + _N + _bucket(len(run))]
        base += 2 * _N
        cue = before.lower().strip(".,:;()#")
        features += [base + i for i, words in enumerate(CUES) if cue in words]
        base += len(CUES)
        features += [base] if 13 <= len(digits) <= 19 and luhn(digits) else []
        features += [base + 1] if 13 <= len(run) <= 19 and luhn(run) else []
        features += [base + 2] if joined else []
        keys = [f"d{run[-7:]}"] if len(run) >= 7 else []
        if quad and all(int(g) <= 255 for g in quad):
            keys.append("q" + ".".join(quad))
        local = re.split(r"@|" + _AT.pattern, word)[0].lower().lstrip("(<[\"'")
        if len(local) < len(word) and len(local) >= 3:
            keys.append(f"l{local}")
        out.append(Token(m.start(), m.end(), word, observed, joined, features, tuple(keys)))
        last_end, before = m.end(), word
    return out


def skip_edges(tokens: list[Token]) -> list[tuple[int, int]]:
    """Tokens with a key in common, each joined to the one before and to the first observed one."""
    seen: dict[str, int] = {}
    sure: dict[str, int] = {}
    edges: set[tuple[int, int]] = set()
    for i, t in enumerate(tokens):
        for k in t.keys:
            edges |= {(j, i) for j in (seen.get(k), sure.get(k)) if j is not None}
            seen[k] = i
            if t.observed >= 0:
                sure.setdefault(k, i)
    # Those that stand before the first observed one.
    for i, t in enumerate(tokens):
        edges |= {(i, j) for k in t.keys if (j := sure.get(k)) is not None and j > i}
    return sorted(edges)


@dataclass
class Field:
    unary: np.ndarray  # features, labels
    chain: np.ndarray  # labels, labels
    skip: np.ndarray  # labels, labels; symmetric

    def marginals(self, tokens: list[Token]) -> np.ndarray:
        """Sum-product belief propagation in the log domain, damped, over all edges at once."""
        n = len(tokens)
        local = np.stack([self.unary[t.features].sum(0) for t in tokens])
        joined = np.array([t.joined for t in tokens])
        followed = np.append(joined[1:], False)
        local += np.where(joined[:, None], 0, self.chain[0][None]) + np.where(followed[:, None], 0, self.chain[:, 0][None])
        for i, t in enumerate(tokens):
            if t.observed >= 0:
                local[i] = np.where(np.arange(LABELS) == t.observed, local[i], -60.0)
        after = np.flatnonzero(joined)
        skips = np.array(skip_edges(tokens), dtype=np.int64).reshape(-1, 2)
        a, b = np.concatenate([after - 1, skips[:, 0]]), np.concatenate([after, skips[:, 1]])
        if not len(a):
            return _softmax(local)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(after), LABELS, LABELS)), np.broadcast_to(self.skip, (len(skips), LABELS, LABELS))])
        # Messages along each edge, both ways.
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        messages = np.zeros((len(source), LABELS))
        for _ in range(ITERATIONS):
            belief = local.copy()
            np.add.at(belief, target, messages)
            out = (belief[source] - messages[back])[:, :, None] + pair
            top = out.max(1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(out - top).sum(1))
            messages = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
        belief = local.copy()
        np.add.at(belief, target, messages)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def generated(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A document with entities in several spellings and look-alikes, and where the entities are."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda xs: xs[rng.integers(len(xs))]

    def phone() -> list[str]:
        a, b, c = str(rng.integers(200, 999)), d(3), d(4)
        return [f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{b}-{c}", f"{a}{b}{c}"]

    def card() -> list[str]:
        digits = "4" + d(14)
        digits += next(str(x) for x in range(10) if luhn(digits + str(x)))
        fours = [digits[i : i + 4] for i in range(0, 16, 4)]
        return [digits, " ".join(fours), "-".join(fours), ".".join(fours), "_".join(fours), "/".join(fours)]

    def ip() -> list[str]:
        parts = [str(x) for x in rng.integers(1, 255, 4)]
        return [".".join(parts), ".".join(parts) + ":8080", "-".join(parts), "[.]".join(parts), ",".join(parts)]

    def email() -> list[str]:
        word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 9)))
        name, host = word() + pick(["", ".", "_", "1"]) + word(), word()
        return [f"{name}@{host}.com", f"{name}(at){host}.com", f"{name}[at]{host}.com", f"{name}@{host}"]

    def other() -> list[str]:
        x = pick([d(3) + "-" + d(4), d(3) + "-" + d(3) + "-" + d(4), d(10), d(7), d(16), ".".join([d(4)] * 4), f"{d(1)}.{d(2)}", f"20{d(2)}-0{rng.integers(1, 9)}-1{d(1)}", d(2), d(4), f"{d(1)},{d(3)}", f"${d(3)}", f"v{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"({d(3)})", f"{d(3)} {d(3)} {d(4)}", f"@{chr(97 + rng.integers(26))}{d(3)}", f"{d(2)}:{d(2)}", f"#{d(5)}"])
        return [x]

    pieces: list[tuple[str, int]] = []
    for _ in range(rng.integers(1, 4)):
        k = int(rng.integers(4))
        forms = (email, ip, card, phone)[k]()
        for _ in range(rng.integers(1, 5)):
            pieces.append((pick(forms[:2]) if rng.random() < 0.5 else pick(forms), k))
    for _ in range(rng.integers(0, 7)):
        pieces += [(pick(other()), -1)] * int(rng.integers(1, 3))
    text, truth = "", []
    for i in rng.permutation(len(pieces)):
        piece, k = pieces[i]
        text += "".join(f"{pick(['the', 'of', 'and', 'in', 'was'])} " for _ in range(rng.integers(1, 4)))
        if k >= 0 and rng.random() < 0.3:
            text += pick(sorted(CUES[k])) + " "
        if k >= 0:
            truth.append((k, len(text), len(text) + len(piece)))
        text += piece + pick(["", ".", ",", ""]) + " "
    return text, truth


@functools.lru_cache(maxsize=1)
def fitted(documents: int = 1200, rounds: int = 250, seed: int = 3) -> Field:
    """Maximum pseudo-likelihood: each token's label given those of its neighbours, with a Gaussian prior, by Adam."""
    rng = np.random.default_rng(seed)
    x, y, prev, follow, near, hidden = [], [], [], [], [], []
    for _ in range(documents):
        text, truth = generated(rng)
        tokens = tokens_of(text, base_spans(text))
        labels = [next((k + 1 for k, s, e in truth if s < t.end and t.start < e), 0) for t in tokens]
        around: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(LABELS))
        for i, j in skip_edges(tokens):
            around[i][labels[j]] += 1
            around[j][labels[i]] += 1
        for i, t in enumerate(tokens):
            row = np.zeros(FEATURES)
            row[t.features] = 1
            x.append(row)
            y.append(labels[i])
            prev.append(labels[i - 1] if t.joined else 0)
            follow.append(labels[i + 1] if i + 1 < len(tokens) and tokens[i + 1].joined else 0)
            near.append(around[i])
            hidden.append(t.observed < 0)
    keep = np.array(hidden)
    x, y, prev, follow, near = (np.array(v)[keep] for v in (x, y, prev, follow, near))
    n, one = len(y), np.eye(LABELS)
    p = {"unary": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for t in range(1, rounds + 1):
        off = (_softmax(x @ p["unary"] + p["chain"][prev] + p["chain"].T[follow] + near @ p["skip"]) - one[y]) / n
        skip = near.T @ off
        g = {"unary": x.T @ off, "chain": one[prev].T @ off + (one[follow].T @ off).T, "skip": skip + skip.T}
        for k in p:
            g[k] += p[k] * 2.0 / n
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.001 * (g[k] ** 2 - v[k])
            p[k] -= 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Field(p["unary"], p["chain"], (p["skip"] + p["skip"].T) / 2)


def _plausible(kind: int, text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return "@" in text or bool(_AT.search(text))
    if kind == 1:
        quad = _quad(text)
        return bool(quad) and all(int(g) <= 255 for g in quad)
    return (13 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 7 <= len(digits) <= 15


def added_spans(text: str, spans: list[Span], field: Field) -> list[Span]:
    """Spans of runs of tokens that the field labels alike, none of them observed."""
    tokens = tokens_of(text, spans)
    if all(t.observed >= 0 for t in tokens):
        return []
    marginals = field.marginals(tokens)
    label = np.where(marginals.max(1) >= CONFIDENCE, marginals.argmax(1), 0)
    out: list[Span] = []
    i = 0
    while i < len(tokens):
        j = i + 1
        if label[i] and tokens[i].observed < 0:
            while j < len(tokens) and tokens[j].joined and label[j] == label[i] and tokens[j].observed < 0:
                j += 1
            start, end = tokens[i].start, tokens[j - 1].end
            trim = text[start:end]
            start += len(trim) - len(trim.lstrip(".,;:!?\"'<[{*#$%&|"))
            end -= len(trim) - len(trim.rstrip(".,;:!?\"'>]}*#$%&|"))
            if start < end and _plausible(int(label[i]) - 1, text[start:end]):
                out.append((int(label[i]) - 1, start, end))
        i = j
    return out


def find(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    if not base and "@" not in text and not _DIGIT.search(text) and not _AT.search(text):
        return [], []
    return base, sorted({*base, *added_spans(text, base, field)})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    field = fitted()

    def work(texts: list[str | None]) -> list[list]:
        found = [find(x, field) for x in texts]
        counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
        digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
        return [*counts, digests, [joined(every) for _, every in found], [len(every) - len(base) for base, every in found]]

    made = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return map_texts(docs, text, keep, made, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
