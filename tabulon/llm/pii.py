"""Personal data: patterns, and a skip-chain conditional random field that adds what the patterns miss.

The patterns give the base spans. The field's tokens are the words that hold a digit or '@', and the words of a spelled-out address ("x at y dot z"). Its potentials are a
token's features (its own shape, the shape of the run of numbers it stands in, words that announce a kind), chain edges
between neighbouring words, and skip edges between occurrences of the same or a similar token however far apart (equal letters and
digits, or equal last seven digits). Loopy sum-product message passing brings the labels of one document into line: a token that says little by itself takes the label of a
clear one that it repeats. Tokens outside all base spans that the field labels become spans, neighbours of one label a single one.

The weights are fitted by pseudo-likelihood to a bounded sample of texts. Their labels are the base spans; half of these are first rewritten to forms that the
patterns don't know (no plus sign, other separators, brackets, spelled-out signs), and plain numbers (amounts, dates, versions) are put among the words, so the field learns to
tell such forms apart in the texts' own surroundings. Finding is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_OR_AT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}<>"
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping. Found from each '@': the run of local characters before it, then a domain after it."""
    at, free = text.find("@"), 0
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots, each at most 255; a longer dotted run is read four numbers at a time."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind, then start."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    out += [(1, a, b) for a, b in addresses(text)] if "." in text else []
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


@dataclass
class Graph:
    """Tokens of one document or many: bounds in the text, feature rows, base label, edges."""

    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    label: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


#: Signs spelled out, and words that announce a kind.
AT_WORDS, DOT_WORDS = ("at", "(at)", "[at]", "{at}"), ("dot", "(dot)", "[dot]", "{dot}")
ANNOUNCE = {
    "email": ("email", "e-mail", "mail", "write", "contact"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "mastercard", "pay"), "phone": ("call", "phone", "tel", "mobile", "fax", "ring"),
}
GROUPS = re.compile(r"[0-9]+")
BRACKET_AT = re.compile(r"[\[({]at[\])}]", re.IGNORECASE)
FEATURES = (
    "always", "at", "at_then_dot", "plus_first", "paren", "letters", "digits_only", "dots_3", "octets", "hyphen", "equals_or_quote", "percent", "spelled", "bracket_at",
    "digits_0", "digits_1_3", "digits_4_6", "digits_7_9", "digits_10_12", "digits_13_15", "digits_16_19", "digits_20_up", "luhn", "four_groups_to_255",
    "run_alone", "run_card", "run_phone",
    *(f"announced_{k}" for k in KINDS),
)
SPELLED = [FEATURES.index(n) for n in ("at", "spelled", "bracket_at")]


def four_groups_to_255(core: str) -> bool:
    got = GROUPS.findall(core)
    return len(got) == 4 and all(len(g) < 4 and int(g) < 256 for g in got)


def run_features(words: list[str]) -> list[list[bool]]:
    """For each of neighbouring words that hold digits and no letters: whether it is alone, part of four groups of four digits that pass Luhn, or of
    groups of three, three and four digits."""
    groups, owner = [], []
    for i, w in enumerate(words):
        got = GROUPS.findall(w)
        groups += got
        owner += [i] * len(got)
    sizes = [len(g) for g in groups]
    card, phone = [False] * len(words), [False] * len(words)
    for i in range(len(groups) - 2):
        if sizes[i : i + 3] == [3, 3, 4]:
            for j in range(owner[i], owner[i + 2] + 1):
                phone[j] = True
        if sizes[i : i + 4] == [4, 4, 4, 4] and luhn("".join(groups[i : i + 4])):
            for j in range(owner[i], owner[i + 3] + 1):
                card[j] = True
    return [[len(words) == 1, card[i], phone[i]] for i in range(len(words))]


def token_features(core: str, spelled: bool, run: list[bool], before: str) -> list[bool]:
    digits = "".join(c for c in core if c in "0123456789")
    n, dots, before = len(digits), core.split("."), before.strip(EDGES).lower()
    return [
        True, "@" in core, "." in core.partition("@")[2], core[:1] == "+", "(" in core or ")" in core, any(c.isalpha() for c in core), core == digits, len(dots) == 4,
        len(dots) == 4 and all(d.isascii() and d.isdigit() and len(d) < 4 and int(d) < 256 for d in dots), "-" in core, "=" in core or '"' in core, "%" in core, spelled, BRACKET_AT.search(core) is not None,
        not n, 0 < n < 4, 4 <= n < 7, 7 <= n < 10, 10 <= n < 13, 13 <= n < 16, 16 <= n < 20, n > 19, 16 <= n < 20 and luhn(digits), four_groups_to_255(core),
        *(run or [False] * 3), *(before in ANNOUNCE[k] for k in KINDS),
    ]


def similar_keys(core: str) -> list[str]:
    """What a token shares with the tokens it is like: its letters and digits (a short one, its very text), and its last seven digits."""
    plain = "".join(c for c in core.lower() if c.isalnum() or c == "@")
    digits = "".join(c for c in plain if c in "0123456789")
    return [f"w{plain}" if len(plain) >= 6 else f"t{core}"] + ([f"d{digits[-7:]}"] if len(digits) >= 7 else [])


def spelled_words(low: list[str]) -> set[int]:
    """Places of the words of addresses spelled out: x at y dot z [dot z]..."""
    out: set[int] = set()
    i = 1
    while i + 3 < len(low):
        if low[i] in AT_WORDS and low[i + 2] in DOT_WORDS:
            j = i + 2
            while j + 1 < len(low) and low[j] in DOT_WORDS:
                j += 2
            out |= set(range(i - 1, j))
            i = j
        else:
            i += 1
    return out


def graph_of(text: str, spans: list[Span]) -> Graph:
    starts, ends, feats, chain, skip, last = [], [], [], [], [], {}
    words = [m.span() for m in TOKEN.finditer(text)] if DIGIT_OR_AT.search(text) or BRACKET_AT.search(text) or re.search(r"\bdot\b", text, re.IGNORECASE) else []
    low = [text[a:b].lower() if b - a < 8 else "" for a, b in words]
    spelled = spelled_words([w.rstrip(",;:!?") for w in low])
    held = [i in spelled or DIGIT_OR_AT.search(text, a, b) is not None or BRACKET_AT.search(text, a, b) is not None for i, (a, b) in enumerate(words)]
    number = [h and i not in spelled and not any(c.isalpha() or c == "@" for c in text[a:b]) for i, (h, (a, b)) in enumerate(zip(held, words))]
    run: list[list[bool]] = []
    first = run_end = 0
    for i, (a, b) in enumerate(words):
        if not held[i]:
            continue
        if number[i] and i >= run_end:
            first, run_end = i, i + 1
            while run_end < len(words) and number[run_end]:
                run_end += 1
            run = run_features([text[x:y].rstrip(".,;:!?") for x, y in words[i:run_end]])
        word = text[a:b]
        a += len(word) - len(word.lstrip(EDGES))
        core = word.strip(EDGES) or word
        n = len(starts)
        if i and held[i - 1]:
            chain.append((n - 1, n))
        for key in similar_keys(core):
            if key in last and (not skip or skip[-1] != (last[key], n)):
                skip.append((last[key], n))
            last[key] = n
        starts.append(a)
        ends.append(a + len(core))
        feats.append(token_features(core, i in spelled, run[i - first] if number[i] else [], low[i - 1] if i else ""))
    start, end = np.array(starts, np.int64), np.array(ends, np.int64)
    label = np.zeros(len(starts), np.int64)
    for kind, a, b in reversed(spans):
        label[np.searchsorted(end, a, "right") : np.searchsorted(start, b, "left")] = kind + 1
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(start, end, np.array(feats, bool).reshape(-1, len(FEATURES)), label, pairs(chain), pairs(skip))


def other_form(kind: int, text: str, rng: np.random.Generator) -> str:
    """The same personal data in a form that the patterns don't know."""
    if kind == 0:
        local, _, domain = text.partition("@")
        at, dot = [(" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", " [dot] "), (" AT ", " DOT ")][rng.integers(5)]
        return local.replace(".", dot if dot.strip() != dot else ".") + at + domain.replace(".", dot)
    if kind == 1:
        return text.replace(".", ["-", "[.]", "(.)", ",", "_"][rng.integers(5)])
    groups = GROUPS.findall(text)
    if kind == 2:
        digits = "".join(groups)
        return [".", "/", "  ", "_", "--"][rng.integers(5)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups = groups[1:] if len(groups) > 2 and rng.random() < 0.7 else groups
    if len(groups) == 3 and rng.random() < 0.4:
        return f"({groups[0]}) {groups[1]}-{groups[2]}"
    return [" ", "-", ".", "/"][rng.integers(4)].join(groups)


def plain_number(rng: np.random.Generator) -> str:
    """A number that is nobody's: an amount, date, time, version, range or serial number."""
    a, b, c, year = (int(x) for x in (rng.integers(1, 13), rng.integers(1, 29), rng.integers(0, 60), rng.integers(1900, 2100)))
    return [
        f"{int(10 ** rng.uniform(0, 10)):,}", f"{year}-{a:02}-{b:02}", f"{b}.{a}.{year}", f"{a}/{b}/{year}", f"{a}:{c:02}:{b:02}", f"{a}:{c:02}", f"{a}.{b}.{c}", f"{a}.{c}", f"{b}%", f"{year}",
        f"{year}-{year + b}", f"{a} {b} {c}", f"{c}-{c + a}", str(int(10 ** rng.uniform(4, 15))), f"{year}/{c}", f"({b})",
    ][rng.integers(16)]


def disturbed(text: str, spans: list[Span], share: float = 0.5, numbers: float = 1.0) -> tuple[str, list[Span]]:
    """The text with about `share` of its spans in other forms and `numbers` plain numbers put between its words, and where the spans are then. Alike for equal texts."""
    rng = np.random.default_rng([len(text), *text.encode("utf-8", "surrogatepass")[:64]])
    edits = [(a, b, kind) for kind, a, b in spans] + [(i, i, -1) for i in rng.integers(0, len(text) + 1, rng.poisson(numbers)).tolist()]
    out, new, at, size = [], [], 0, 0
    for a, b, kind in sorted(edits):
        if kind < 0:
            a = b = text.find(" ", max(a, at))
        if a < at:
            continue
        own = f" {plain_number(rng)}" if kind < 0 else other_form(kind, text[a:b], rng) if rng.random() < share else text[a:b]
        if kind < 0 and any(x <= a < y for x, y, k in edits if k >= 0):
            continue
        out += [text[at:a], own]
        size += a - at
        if kind >= 0:
            new.append((kind, size, size + len(own)))
        size += len(own)
        at = b
    return "".join((*out, text[at:])), sorted(new)


def joined(graphs: list[Graph]) -> Graph:
    at = np.cumsum([0] + [len(g.start) for g in graphs])
    cat = lambda name: np.concatenate([getattr(g, name) for g in graphs])
    moved = lambda name: np.concatenate([getattr(g, name) + o for g, o in zip(graphs, at)])
    return Graph(cat("start"), cat("end"), cat("features"), cat("label"), moved("chain"), moved("skip"))


@dataclass
class Field:
    """unary: features x labels; chain: label x next label; skip: what agreement on a label adds."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


#: Mean of the Gaussian prior on the skip weights.
SKIP_PRIOR = 3.0


def possible(features: np.ndarray) -> np.ndarray:
    """0 where a token may have a label, else a large negative number: an email holds '@' or stands for it, the other kinds hold a digit."""
    out = np.zeros((len(features), len(LABELS)))
    out[~features[:, SPELLED].any(axis=1), 1] = -50
    out[features[:, FEATURES.index("digits_0")], 2:] = -50
    return out


def fit(g: Graph, steps: int = 400, rate: float = 0.05, l2: float = 1e-5) -> Field:
    """Maximum pseudo-likelihood with Gaussian priors, by Adam; every token is predicted from its features and its neighbours' base labels.
    Labels weigh by the root of how rare they are, since most tokens are outside all spans."""
    n, k = len(g.label), len(LABELS)
    often = np.bincount(g.label, minlength=k)
    weight = (1 / np.sqrt(np.maximum(often, 1)))[g.label][:, None]
    hot = np.eye(k)[g.label]
    x, fixed = g.features.astype(float), possible(g.features)
    params = [np.zeros((x.shape[1], k)), np.zeros((k, k)), np.full(k, SKIP_PRIOR)]
    if not n:
        return Field(*params)

    def spread(edges: np.ndarray, value: np.ndarray, to: int) -> np.ndarray:
        out = np.zeros((n, value.shape[1]))
        np.add.at(out, edges[:, to], value)
        return out

    left, right = spread(g.chain, hot[g.chain[:, 0]], 1), spread(g.chain, hot[g.chain[:, 1]], 0)
    agree = spread(g.skip, hot[g.skip[:, 0]], 1) + spread(g.skip, hot[g.skip[:, 1]], 0)
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        u, c, s = params
        z = fixed + x @ u + left @ c + right @ c.T + agree * s
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - hot) * weight / weight.sum()
        grads = [x.T @ d + l2 * u, left.T @ d + d.T @ right + l2 * c, (d * agree).sum(axis=0) + l2 * (s - SKIP_PRIOR)]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Field(params[0], params[1], np.maximum(params[2], 0.0))


def beliefs(g: Graph, f: Field, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Each token's label distribution by loopy sum-product, all edges of all documents at once. Tokens of base spans are observed."""
    n, k = len(g.start), len(LABELS)
    unary = possible(g.features) + g.features @ f.unary + np.where(g.label[:, None] > 0, 50.0 * (np.arange(k) == g.label[:, None]), 0.0)
    src = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
    dst = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
    nc, ns = len(g.chain), len(g.skip)
    back = np.concatenate([np.arange(nc) + nc, np.arange(nc), np.arange(ns) + ns + 2 * nc, np.arange(ns) + 2 * nc])
    pots = [(slice(0, nc), np.exp(f.chain)), (slice(nc, 2 * nc), np.exp(f.chain.T)), (slice(2 * nc, 2 * nc + 2 * ns), np.exp(np.diag(f.skip)))]
    msg = np.zeros((len(src), k))

    def total() -> np.ndarray:
        out = unary.copy()
        np.add.at(out, dst, msg)
        return out

    for _ in range(rounds if len(src) else 0):
        out = total()[src] - msg[back]
        p = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.empty_like(msg)
        for where, pot in pots:
            new[where] = np.log(p[where] @ pot + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        msg = damping * msg + (1 - damping) * new
    z = total() if len(src) else unary
    p = np.exp(z - z.max(axis=1, keepdims=True)) if n else z
    return p / p.sum(axis=1, keepdims=True) if n else p


def added_spans(g: Graph, f: Field, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """(token, kind) of tokens outside base spans that the field labels."""
    b = beliefs(g, f)
    best = b.argmax(axis=1) if len(b) else np.zeros(0, np.int64)
    take = (g.label == 0) & (best > 0) & (b[np.arange(len(b)), best] >= sure) if len(b) else np.zeros(0, bool)
    return np.flatnonzero(take), best[take] - 1


#: What may stand between two tokens of one added span.
BETWEEN = re.compile(r"[\x20\x09(),./_-]{1,3}")


def find_all(texts: list[str | None], f: Field, sure: float = 0.75) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t or "") for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    graphs = [graph_of(t or "", s) for t, s in zip(texts, base)]
    who = np.repeat(np.arange(len(texts)), [len(g.start) for g in graphs])
    if len(who):
        g = joined(graphs)
        before = -2
        for t, kind in zip(*added_spans(g, f, sure)):
            spans, a, b = added[who[t]], int(g.start[t]), int(g.end[t])
            text = texts[who[t]]
            if before == t - 1 and spans and spans[-1][0] == kind and BETWEEN.fullmatch(text, spans[-1][2], a):
                a = spans.pop()[1]
            elif a and text[a - 1] == "(" and text[b : b + 1] == ")":
                a, b = a - 1, b + 1
            spans.append((int(kind), a, b))
            before = t
    return list(zip(base, (sorted(a) for a in added)))


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 6000) -> Field:
    """The field fitted to at most sample_docs texts (those of the rows with the smallest hash of id and text, each once, whole). The bound holds for fitting only;
    finding reads every text. Null texts and tables without personal data give a field that adds nothing."""
    rows = docs.select(column(text_col).alias("text"), F.xxhash64(column(id_col), column(text_col)).alias("h")).where("text IS NOT NULL")
    first = rows.select("h").distinct().orderBy("h").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                g = graph_of(*disturbed(t, base_spans(t)))
                if len(g.start):
                    out.append((i, np.packbits(g.features, axis=1).tobytes(), g.label.tolist(), g.chain.ravel().tolist(), g.skip.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3))], names=["h", "f", "label", "chain", "skip"])

    rows = rows.join(F.broadcast(first), "h").select("text", "h").dropDuplicates(["h"])  # sample_docs rows at most
    rows = arrow_map(rows, run, "h bigint, f binary, label array<bigint>, chain array<bigint>, skip array<bigint>").collect()
    width = -(-len(FEATURES) // 8)
    graphs = []
    for r in sorted(rows):
        feats = np.unpackbits(np.frombuffer(r.f, np.uint8).reshape(-1, width), axis=1)[:, : len(FEATURES)].astype(bool)
        graphs.append(Graph(np.zeros(len(feats), np.int64), np.zeros(len(feats), np.int64), feats, np.array(r.label), np.array(r.chain, np.int64).reshape(-1, 2), np.array(r.skip, np.int64).reshape(-1, 2)))
    return fit(joined(graphs or [graph_of("", [])]))


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.75) -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end), in code points, end exclusive, by kind then start; spans are the base spans and the added ones.

    A null text counts as empty and has none. Repeated and null ids are rows of their own. An empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = find_all(part.column(1).to_pylist(), field, sure)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([rows(x) for x, _ in found], kind), pa.array([rows(x + y) for x, y in found], kind)], names=["id", "base", "spans"])

    id_kind, span = docs.schema[id_col].dataType.simpleString(), "array<struct<kind:string,start:bigint,end:bigint>>"
    return arrow_map(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), run, f"id {id_kind}, base {span}, spans {span}")
