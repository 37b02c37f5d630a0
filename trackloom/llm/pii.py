"""Personal data by candidate gradient boosting.

Generators with high recall propose spans that may overlap: the four base patterns, and forms that these miss: every run of
digit groups of a card's or a phone number's size, addresses with "at" and "dot" spelled out, defanged IP addresses, IPv6.
Boosted trees score the added candidates from format and context features; a threshold a kind, the least score whose
calibrated chance (isotonic, on held-out examples) is `CERTAIN`, selects those to redact. Base spans always stay.

The trees are trained here, on the driver, from `EXAMPLES` invented labelled spans (a documented bound, fixed seed); the
model is a few kB and goes to the executors with the task. Examples of data and of lookalikes (order numbers, dates, ISBNs,
prices, places of meeting) share their formats, and hints may lack or mislead, so that no single feature tells them apart.

Each document is handled alone and whole, in one pass without a shuffle. Every pattern is linear in the text: runs of
digits or letters that fail are not tried again from their middle. Candidates that overlap are weighed against each other
within their cluster, found by one sweep over the spans in order. Only the context features look at a window of `CONTEXT`.

Defined results
* null or empty text: no spans, counts 0, the digest of the empty string.
* very long texts: searched whole. Repeated rows: each on its own. Empty table: an empty result; other columns do not matter.
* ties: of overlapping added candidates the higher score wins, then the earlier, then the longer. One that overlaps a base
  span goes.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import read_table, with_fields

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 9000
CERTAIN = 0.6
SEED = 20240
CONTEXT = 28
#: Candidates that are scored at a time.
SCORED = 1 << 14

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Digits a phone number and a card number has.
PHONE_DIGITS, CARD_DIGITS = (7, 15), (13, 19)
_GROUP = re.compile(r"[0-9]++")
#: What may stand between two groups of one number.
_BETWEEN = re.compile(r" ?[().\-/_] ?\(?| \(?")
_AT = re.compile(r" *+[\[({] *+at *+[\])}] *+| ++at ++| *+@ *+", re.I)
_AT_CORE = re.compile(r"[aA@][tT]?+(?=[ \])}]|(?<=@))")
_ENDS_IN_NUMBER = re.compile(r"(?<![A-Za-z0-9])[0-9]++[ ().\-/_]{1,2}$")
_GOES_ON = re.compile(r"[ ().\-/_]{1,2}[0-9]")
_TWO_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_DOT = r"(?:\.| ++dot ++| *+[\[({] *+(?:dot|\.) *+[\])}] *+)"
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", re.I)
_DOTS = re.compile(_DOT, re.I)
_OCTETS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])")

#: Words near a span that speak for a kind, in the order of KINDS, words that speak against all, and common ends of host names.
_HINTS = (
    ("mail", "contact", "correo", "courriel", "write", "reach"),
    ("ip", "host", "server", "address", "adresse", "client"),
    ("card", "visa", "karte", "carte", "tarjeta", "credit", "pay"),
    ("phone", "tel", "call", "mobile", "fax", "ring", "telefon", "llam"),
)
_AGAINST = ("version", "order", "isbn", "invoice", "page", "section", "chapter", "part no", "id", "ref", "serial", "total", "price", "year", "date")
_ENDS = frozenset("com org net edu gov io info de fr es uk it eu".split())


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Start and end of the base matches that hold, for each kind in the order of KINDS."""
    emails, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            emails.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return [emails, [], [], []]
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _only_digits(m[0])) <= 19 and _luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15] if "+" in text else []
    return [emails, ips, cards, phones]


def _number_runs(text: str):
    """Start and end of the digit groups of each run whose gaps may stand within one number."""
    run: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        if run and not _BETWEEN.fullmatch(text, run[-1][1], m.start()):
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the further generators propose, in order; spans may overlap."""
    found = set()
    for core in _AT_CORE.finditer(text):
        begin = core.start()
        while begin and text[begin - 1] == " ":
            begin -= 1
        if begin and text[begin - 1] in "[({":
            begin -= 1
            while begin and text[begin - 1] == " ":
                begin -= 1
        start = begin
        while start and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, begin) if start < begin else None
        host = _HOST.match(text, m.end()) if m and m.end() > core.start() else None
        if host:
            found.add((0, start, host.end()))
    if _TWO_COLONS.search(text):
        found.update((1, *m.span()) for m in _COLONS.finditer(text))
    if _DIGIT.search(text):
        found.update((1, *m.span()) for m in _OCTETS.finditer(text))
        for run in _number_runs(text):
            for i, (start, _) in enumerate(run):
                digits = 0
                for a, b in run[i:]:
                    digits += b - a
                    if digits > CARD_DIGITS[1]:
                        break
                    opened = start - (start > 0 and text[start - 1] == "(" and ")" in text[start:b])
                    if PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]:
                        found.add((3, opened, b))
                    if digits >= CARD_DIGITS[0]:
                        found.add((2, start, b))
    return sorted(found)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _only_digits(span)
    left, right = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    near = f"{left} {right}"
    groups = _GROUP.findall(span)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[start - 1 : start], text[end : end + 1]
    at = _AT.search(span) if kind == 0 else None
    local, host = (span[: at.start()], span[at.end() :]) if at else ("", "")
    labels = _DOTS.split(host) if host else []
    hex_groups = span.split(":") if kind == 1 else []
    continued = [kind > 1 and bool(_ENDS_IN_NUMBER.search(left)), kind > 1 and bool(_GOES_ON.match(right))]
    return [
        kind,
        len(span),
        len(digits),
        len(groups),
        max(sizes),
        min(sizes),
        sizes[0],
        sizes[-1],
        float(_luhn(digits)) if digits else 0.0,
        max((int(g[:9]) for g in groups), default=0) if kind == 1 else 0.0,
        len(set(digits)),
        float(digits[:1] == "0") + float(digits[:2] == "00"),
        float(span[:1] == "("),
        span.count(" "),
        span.count("-"),
        span.count("."),
        span.count("/") + span.count("_"),
        sum(span.count(c) for c in "[({"),
        float(digits[:1] in ("3", "4", "5", "6")),
        sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups),
        float(digits[:3] in ("978", "979")),
        float(before.isalnum()) + 2.0 * continued[0],
        float(after.isalnum()) + 2.0 * continued[1],
        float(before in tuple("$€£#=+.,") and before != "") + float(after in tuple("%€$,") and after != ""),
        sum(h in left for h in _HINTS[kind]) + 0.5 * sum(h in right for h in _HINTS[kind]),
        sum(h in left for h in _AGAINST) + 0.5 * sum(h in right for h in _AGAINST),
        float(sum(c.isdigit() for c in near)),
        float(bool(at) and at[0].strip().lower() != "at"),
        float(bool(re.search("[0-9._+-]", local))),
        len(local),
        len(labels),
        float(bool(labels) and labels[-1].lower() in _ENDS),
        float(" dot " in host.lower() or any(c in host for c in "[({")),
        span.count(":"),
        float("::" in span),
        max((len(g) for g in hex_groups), default=0),
        float(sum(len(g) == 2 for g in hex_groups)),
    ]


def _digits(rng: random.Random, n: int, first: str = "0123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _card(rng: random.Random, good: bool) -> str:
    """A number of a card's size; a good one nearly always ends in its check digit, a lookalike does by chance or as some serial numbers do."""
    n = rng.choice((16, 16, 16, 15, 13, 14, 17, 18, 19))
    digits = _digits(rng, n - 1, "3456" if good or rng.random() < 0.4 else "0123456789")
    valid = rng.random() < (0.97 if good else 0.12)
    digits += rng.choice([c for c in "0123456789" if _luhn(digits + c) == valid])
    shape = rng.random()
    if shape < 0.35:
        return digits
    step = (4, 4, 4, 4, 4) if shape < 0.9 else rng.choice(((4, 6, 5, 4), (5, 5, 5, 4), (6, 7, 6), (3, 3, 3, 3, 3, 4)))
    parts, at = [], 0
    for k in step:
        parts.append(digits[at : at + k])
        at += k
    return rng.choice((" ", "-", ".", "/", "_")).join(x for x in parts if x)


def _phone(rng: random.Random) -> str:
    d = functools.partial(_digits, rng)
    s = rng.choice((" ", "-", ".", " ", "/"))
    return rng.choice((
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: s.join((d(3), d(3), d(4))), lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(2)}{s}{d(7)}", lambda: s.join((f"0{d(1)}", d(2), d(2), d(2), d(2))),
        lambda: f"00{d(2)} {d(2)} {d(6)}", lambda: f"00{d(2)}{s}{d(3)}{s}{d(3)}{s}{d(3)}", lambda: f"0{d(3)}{s}{d(6)}", lambda: s.join((d(3, "6789"), d(3), d(3))), lambda: f"{d(3)}{s}{d(4)}", lambda: f"0{d(9)}",
    ))()


def _like_phone(rng: random.Random) -> str:
    d = functools.partial(_digits, rng)
    s = rng.choice((" ", "-", ".", "/"))
    two = lambda most: f"{rng.randint(1, most):02d}"
    return rng.choice((
        lambda: s.join((str(rng.randint(1900, 2099)), two(12), two(31))), lambda: s.join((two(31), two(12), str(rng.randint(1900, 2099)))), lambda: f"{rng.randint(1900, 2029)}-{rng.randint(1900, 2029)}",
        lambda: d(rng.randint(7, 12)), lambda: s.join((d(3), d(3), d(4))), lambda: s.join(("978", d(1), d(2), d(6), d(1))), lambda: " ".join((d(rng.randint(1, 3), "123456789"), d(3), d(3))),
        lambda: f"{d(3)}-{d(7)}-{d(7)}", lambda: ".".join(d(rng.randint(1, 3)) for _ in range(4)), lambda: " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(3, 7))), lambda: f"{d(4)}/{d(4)}",
    ))()


def _address(rng: random.Random, word, good: bool) -> str:
    at = rng.choice((" at ", " [at] ", "(at)", "[at]", "{at}", " (at) ", " @ "))
    dot = rng.choice((" dot ", " [dot] ", "(dot)", "[dot]", " (dot) ", "."))
    end = rng.choice(("com", "org", "net", "de", "fr", "es", "edu", "uk", "info"))
    if good:
        local = rng.choice((lambda: word(), lambda: f"{word()}.{word()}", lambda: f"{word()}_{word()}", lambda: f"{word()}{_digits(rng, 2)}"))()
        if at == " at " and dot == "." and rng.random() < 0.7:
            local = f"{word()}.{word()}"
        return f"{local}{at}{dot.join([word() for _ in range(rng.choice((1, 1, 2)))] + [end])}"
    return rng.choice((
        lambda: f"{word()} at {word()}.{end}", lambda: f"{word()} at {word()}.{word().capitalize()}", lambda: f"{word()} at {word()} dot {word()}{word()}", lambda: f"{word()} [at] {word()}.{word()}{word()}", lambda: f"{_digits(rng, 2)} @ {_digits(rng, 1)}.{_digits(rng, 2)}",
    ))()


def _host_number(rng: random.Random, good: bool) -> str:
    if rng.random() < 0.4:
        if good:
            groups = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
            if rng.random() < 0.6:
                a, b = rng.randint(1, 3), rng.randint(1, 3)
                return ":".join(groups[:a]) + "::" + ":".join(groups[:b])
            return ":".join(groups)
        two = lambda: f"{rng.randrange(60):02d}"
        return rng.choice((lambda: f"{two()}:{two()}:{two()}", lambda: ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), lambda: f"{rng.randint(1, 9)}:{rng.randint(1, 99)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}", lambda: f"::{rng.choice('abcdef')}:"))()
    octet = lambda: str(rng.randint(0, 255) if good or rng.random() < 0.5 else rng.randint(100, 999))
    o = [octet() for _ in range(4)] if good or rng.random() < 0.6 else [str(rng.randint(0, 20)) for _ in range(4)]
    return rng.choice(("[.]", "(.)", "[dot]", " dot ", "(dot)")).join(o)


def _invented(rng: random.Random) -> tuple[str, int, int, int, int]:
    """A labelled example: text, kind, start, end, whether it is personal data. The label is what the number was made as, whatever it looks like."""
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8)))
    kind, good = rng.randrange(4), rng.random() < 0.5
    span = (lambda: _address(rng, word, good), lambda: _host_number(rng, good), lambda: _card(rng, good), lambda: _phone(rng) if good else _like_phone(rng))[kind]()
    draw = rng.random()
    if good:
        hints = _HINTS[kind] if draw < (0.85 if kind == 3 else 0.5) else _AGAINST if draw > 0.98 else ()
    else:
        hints = _AGAINST if draw < 0.5 else _HINTS[kind] if draw > 0.96 else ()
    lead = f"{word()} {rng.choice(hints) if hints else word()}{rng.choice((' ', ': ', ' is ', ' no. '))}"
    tail = rng.choice((f" {word()} {word()}", ".", ",", f", {word()}", ""))
    if kind > 1 and rng.random() < 0.25:  # numbers that stand side by side
        beside = _phone(rng) if kind == 2 or rng.random() < 0.5 else _card(rng, True)
        if rng.random() < 0.5:
            lead += rng.choice(("+1 ", "")) + beside + " "
        else:
            tail = f" {beside}{tail}"
    text = f"{word()} {lead}{span}{tail}"
    start = len(text) - len(tail) - len(span)
    return text, kind, start, start + len(span), int(good)


def _labelled(rng: random.Random) -> list[tuple[str, int, int, int, int]]:
    """An example and, as lookalikes, what the generators propose besides inside its span: parts of a number, or a number taken for another kind."""
    text, kind, start, end, good = _invented(rng)
    rows = [(text, kind, start, end, good)]
    others = [c for c in candidates(text) if c != (kind, start, end) and c[1] < end and start < c[2]]
    return rows + [(text, *c, 0) for c in rng.sample(others, min(2, len(others)))]


def least_certain(scores: np.ndarray, truth: np.ndarray, certain: float) -> float:
    """The score from which the calibrated chance of truth is `certain`, half-way between the examples on either side; 2 if none is.

    The chance is the isotonic regression of truth on score."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # least and greatest score, sum of truth, number
    for score, t in zip(scores[order].tolist(), truth[order].tolist()):
        blocks.append([score, score, t, 1])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + t, blocks[-1][3] + n]
    below = 0.0
    for low, high, t, n in blocks:
        if t >= certain * n:
            return (below + low) / 2
        below = high
    return 2.0


@functools.lru_cache(maxsize=2)
def trained(examples: int = EXAMPLES, seed: int = SEED) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The model and, for each kind, the least score that is right with a chance of CERTAIN, calibrated on the held-out third."""
    rng = random.Random(seed)
    rows, group = [], []
    for n in range(examples):
        own = _labelled(rng)
        rows += own
        group += [n] * len(own)
    x, y = np.array([features(t, k, a, b) for t, k, a, b, _ in rows], float), np.array([r[4] for r in rows], float)
    kinds, held = x[:, 0].astype(int), np.array(group) % 3 == 0
    model = BoostedTrees(trees=60, depth=4).fit(x[~held], y[~held])
    scores = model.score(x)
    limits = []
    for kind in range(4):
        own = held & (kinds == kind)
        limits.append(least_certain(scores[own], y[own], CERTAIN))
    return model, tuple(limits)


def _clear(proposed: list[tuple[int, int, int]], base) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span."""
    joined: list[list[int]] = []
    for a, b in sorted(s for spans in base for s in spans):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    if not joined:
        return proposed
    ends = [b for _, b in joined]
    out = []
    for c in proposed:
        k = bisect.bisect_right(ends, c[1])  # the first that ends behind the candidate's start
        if k == len(joined) or joined[k][0] >= c[2]:
            out.append(c)
    return out


def choose(scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (score, kind, start, end) those that overlap no better one: by score, then the earlier, then the longer, then by kind.

    Spans are swept by start into clusters that do not touch each other; within a cluster the taken ones are kept in order.
    """
    chosen: list[tuple[int, int, int]] = []
    cluster: list[tuple[float, int, int, int]] = []

    def settle() -> None:
        starts: list[int] = []
        ends: list[int] = []
        for _, kind, a, b in sorted(cluster, key=lambda c: (-c[0], c[2], -c[3], c[1])):
            k = bisect.bisect_left(starts, a)
            if (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b):
                starts.insert(k, a)
                ends.insert(k, b)
                chosen.append((kind, a, b))

    reach = -1
    for c in sorted(scored, key=lambda c: c[2]):
        if cluster and c[2] >= reach:
            settle()
            cluster = []
        cluster.append(c)
        reach = max(reach, c[3])
    settle()
    return chosen


def _added(texts: list[str], bases: list, model: BoostedTrees, limits) -> list[list[tuple[int, int, int]]]:
    """For each text the candidates that pass their kind's limit and overlap neither a base span nor a better candidate. Scored together."""
    passed: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    waiting: list[tuple[int, int, int, int]] = []
    rows: list[list[float]] = []

    def score() -> None:
        if rows:
            for value, (n, kind, a, b) in zip(model.score(np.array(rows, float)).tolist(), waiting):
                if value >= limits[kind]:
                    passed[n].append((value, kind, a, b))
        waiting.clear()
        rows.clear()

    for n, (text, base) in enumerate(zip(texts, bases)):
        for c in _clear(candidates(text), base):
            waiting.append((n, *c))
            rows.append(features(text, *c))
            if len(rows) >= SCORED:
                score()
    score()
    return [choose(p) for p in passed]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """`keep` columns, base counts a kind, base_sha256, all spans; with `redact`, the text with each span replaced by its kind in brackets."""
    import pandas as pd

    sent = docs.sparkSession.sparkContext.broadcast(trained())
    fields = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string" + ", redacted string" * redact
    schema = with_fields(docs.select(*[F.col(f"`{c}`") for c in keep]).schema, fields)

    def one(text: str, base, added):
        flat = [(k, a, b) for k, spans in enumerate(base) for a, b in spans]
        every = sorted(flat + added)
        row = [*map(len, base), hashlib.sha256(_joined(flat).encode()).hexdigest(), _joined(every)]
        if redact:
            out, at = [], 0
            for k, a, b in sorted(every, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += [text[at:a], f"[{KINDS[k].upper()}]"]
                at = max(at, b)
            row.append("".join(out) + text[at:])
        return row

    def run(frames):
        for frame in frames:
            texts = [t or "" for t in frame["_text"]]
            bases = [base_spans(t) for t in texts]
            rows = [one(*x) for x in zip(texts, bases, _added(texts, bases, *sent.value))]
            found = pd.DataFrame(rows, columns=schema.names[len(keep) :], index=frame.index)
            yield pd.concat([frame[list(keep)], found], axis=1)

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return source.mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))
