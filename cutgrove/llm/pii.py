"""Personal data by candidate gradient boosting.

High-recall generators read the whole text and propose overlapping spans: every base pattern match (kept always),
key-value secrets and tokens of any length, with or without digits, grouped numbers and account codes. Boosted trees read the format of a span and its context and give a
probability; per-kind thresholds, calibrated on held-out examples for a wanted precision, select redactions. Of
overlapping selected spans that are not base matches the longest stays, so that no part of one is left; of equal ones the likeliest. The trees are trained here on examples made
by rule from a seed.

Offsets are code points, ends exclusive. Null and empty texts have no spans; empty tables give no rows. Repeated rows stay.
Candidates have no greatest length. Of spans with equal length and probability the first stays, then ``ident``. Columns
besides the text are kept by name and never read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the method adds.
ADDED = ("secret", "ident")

LOCAL = string.ascii_letters + string.digits + "._%+-"
DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(x - 9 if (x := 2 * int(d)) > 9 else x for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind, in the order of BASE, then by start; linear in the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        head = text[done:at]
        local = len(head) - len(head.rstrip(LOCAL))
        if local and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", at - local, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1  # no match holds two @ and none begins before this one
            at = text.find("@", at + 1)
    if DIGIT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if m.end() - m.start() >= 9 and 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


ACCESS = "AKIA"
SEPARATOR = re.compile("[=:]")
#: A key word right before a separator, at the end of the LEAD characters there.
KEYWORD = re.compile(r"""(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|key)["']?\s{0,3}\Z""")
LEAD = 12
VALUE = re.compile(r"""\s{0,3}["']?([^\s"',;]{4,})""")
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{12,}+")
#: Fixed formats: an access key id, and three or more parts of a signed token with the dots between them.
KEY = re.compile(ACCESS + "[A-Z0-9]{16}(?![A-Z0-9])")
SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{2,}+){1,}+")
#: A word for something private, perhaps "is" or "no.", and a value; all of it on one line.
HINTED = re.compile(r"""(?i)\b(password|passwd|passport|account|iban|ssn|pin|secret|token)\b[ \t]{0,3}(?:(?:is|was|no\.?|number|nr\.?|code|id)\b\.?[ \t]{0,3})?[:#=]?[ \t]{0,3}["']?([A-Za-z0-9][A-Za-z0-9-]{3,}+)""")
#: Runs of digits and what groups them, of any length; a candidate begins with a digit or bracket and ends with a digit.
GROUPS = re.compile(r"[0-9 ().-]{7,}+")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")


def values(text: str):
    """(start, end) of what stands behind a key word and a separator, outermost values only; linear in the text."""
    done = 0
    for m in SEPARATOR.finditer(text):
        at = m.start()
        if at >= done - 1 and KEYWORD.search(text, max(0, at - LEAD), at) and (v := VALUE.match(text, at + 1)):
            done = v.end()
            yield v.span(1)


def candidates(text: str) -> list[tuple[str, int, int]]:
    found = {("secret", *span) for span in values(text)}
    named = sorted(found)  # a token that holds a key word and its value gives way to the value
    for m in TOKEN.finditer(text):
        i = bisect_left(named, ("secret", m.start() + 1))
        if i == len(named) or named[i][1] >= m.end():
            found.add(("secret", *m.span()))
    if ACCESS in text:
        found |= {("secret", *m.span()) for m in KEY.finditer(text)}
    if "eyJ" in text:
        found |= {("secret", *m.span()) for m in SIGNED.finditer(text)}
    found |= {("ident" if m[1][:2].lower() in ("ac", "ib", "ss") or m[1][:5].lower() == "passp" else "secret", *m.span(2)) for m in HINTED.finditer(text)}
    if DIGIT.search(text) is not None:
        found |= {("ident", *m.span()) for m in ACCOUNT.finditer(text)}
        for m in GROUPS.finditer(text):
            a, b = m.end() - len(m.group().lstrip(" ).-")), m.start() + len(m.group().rstrip(" ().-"))
            if b - a >= 7:
                found.add(("ident", a, b))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


#: Words that stand before personal data or secrets, or before plain numbers.
HINTS = ("password", "passwd", "token", "secret", "key", "ssn", "social", "iban", "account", "phone", "tel", "call", "passport", "version", "page", "order", "isbn", "price", "year")


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    before, after = text[max(0, a - 24) : a].lower(), text[b : b + 4]
    digits = sum(map(str.isdigit, s))
    upper, lower = sum(map(str.isupper, s)), sum(map(str.islower, s))
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts) if s else 0.0
    groups = [len(x) for x in re.findall("[0-9]+", s)]
    switches = sum((x.isdigit() != y.isdigit()) for x, y in zip(s, s[1:]))
    return [
        float(kind == "secret"), float(len(s)), float(digits), float(upper), float(lower), digits / max(1, len(s)), entropy, float(len(groups)),
        float(max(groups, default=0)), float(min(groups, default=0)), float(groups[:3] == [3, 2, 4]), float(groups[-2:] == [3, 4] or groups[-2:] == [4, 4]), float(switches), float(s.count("-")), float(s.count(".")), float(s.count(" ")),
        float(bool(KEY.fullmatch(s)) or s.startswith(("ghp_", "sk-", "xox"))), float(bool(SIGNED.fullmatch(s))), float(bool(re.fullmatch("[0-9a-f]+", s))), float(bool(ACCOUNT.fullmatch(s))), float("=" in before[-3:] or ":" in before[-3:]),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(s[:1].isupper()), *(float(h in before) for h in HINTS),
    ]


def examples(seed: int = 7, n: int = 2400) -> list[tuple[str, list[float], int]]:
    """(kind, features, label) from made texts: secrets, ids and accounts against versions, dates, codes, sums and words."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum, digits = "0123456789abcdef", string.ascii_letters + string.digits, string.digits
    words = lambda k: " ".join(pick(string.ascii_lowercase, r.randint(2, 9)) for _ in range(k))
    plain = lambda k: "".join(pick(string.ascii_lowercase, r.randint(3, 9)) for _ in range(k))
    good = (
        lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16),
        lambda: f"{r.choice(('password', 'passwd', 'pwd', 'Password'))}{r.choice(('=', ': ', ' = '))}{pick(r.choice((hexa, alnum)), r.randint(8, 24))}",
        lambda: f"{r.choice(('token', 'secret', 'api_key', 'key'))}{r.choice(('=', ' = ', ': '))}\"{pick(r.choice((hexa, alnum)), r.randint(16, 48))}\"",
        lambda: r.choice(("ghp_", "sk-", "xoxb-")) + pick(alnum, r.randint(20, 40)),
        lambda: pick(hexa, r.choice((32, 40, 64))),
        lambda: f"{pick('123456', 3)}-{pick(digits, 2)}-{pick(digits, 4)}",
        lambda: f"{r.choice(('tel', 'phone', 'call'))} ({pick('23456789', 3)}) {pick(digits, 3)}-{pick(digits, 4)}",
        lambda: f"({pick('23456789', 3)}) {pick(digits, 3)}-{pick(digits, 4)}",
        lambda: r.choice(("DE", "FR", "ES", "GB")) + pick(digits, 2) + "".join(r.choice(("", " ")) + pick(digits, 4) for _ in range(4)) + pick(digits, 2),
        lambda: f"{r.choice(('password', 'passwd', 'pwd', 'Password'))}{r.choice(('=', ': ', ' = '))}{r.choice((plain(r.randint(2, 4)), pick(string.ascii_letters, r.randint(8, 24))))}",
        lambda: f"{r.choice(('token', 'secret', 'api_key', 'key'))}{r.choice(('=', ' = ', ': '))}\"{pick(string.ascii_letters, r.randint(12, 48))}\"",
        lambda: "AKIA" + pick(string.ascii_uppercase, 16),
        lambda: r.choice(("ghp_", "sk-", "xoxb-")) + pick(string.ascii_letters, r.randint(20, 40)),
        lambda: f"{r.choice(('password', 'token', 'secret', 'api_key', 'key'))}{r.choice(('=', ': '))}{pick(alnum + '+/', r.randint(100, 600))}",
        lambda: "eyJ" + pick(alnum + "_-", r.randint(10, 40)) + "." + pick(alnum + "_-", r.randint(20, 200)) + "." + pick(alnum + "_-", r.randint(20, 60)),
        lambda: f"{r.choice(('password', 'Password', 'passwd'))} is {plain(1)}{pick(digits, r.randint(1, 4))}{pick(alnum, r.randint(2, 6))}",
        lambda: f"{r.choice(('passport', 'Passport', 'PASSPORT no.', 'passport number'))} {pick(string.ascii_uppercase, 1)}{pick(digits, 2)}{pick(string.ascii_uppercase + digits, 6)}",
        lambda: f"{r.choice(('account', 'ACCOUNT', 'Account number', 'account no.'))} {pick(digits, r.randint(8, 14))}",
    )
    bad = (
        lambda: f"{r.choice(('version', 'v'))} {r.randint(1, 20)}.{r.randint(0, 30)}.{r.randint(0, 9)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
        lambda: f"{r.choice(('page', 'order', 'price', 'year'))} {pick(digits, r.randint(1, 9))}",
        lambda: f"{r.randint(1, 999)} {pick(digits, 3)} {pick(digits, 3)}",
        lambda: f"isbn {pick(digits, 3)}-{pick(digits, 1)}-{pick(digits, 5)}-{pick(digits, 3)}-{pick(digits, 1)}",
        lambda: f"{words(1)}-{words(1)}-{r.randint(1, 99)}",
        lambda: f"{pick(string.ascii_lowercase, r.randint(11, 22))}{r.randint(1, 99)}",
        lambda: f"{r.randint(0, 9)}.{pick(digits, 6)} {r.randint(0, 9)}.{pick(digits, 6)}",
        lambda: f"{pick(digits, 2)}:{pick(digits, 2)}:{pick(digits, 2)} {pick(digits, 2)}.{pick(digits, 2)}.{r.randint(1990, 2030)}",
        lambda: f"({r.randint(1900, 2030)}) {pick(digits, 2)}-{pick(digits, 2)}",
        lambda: pick(string.ascii_lowercase, r.randint(12, 24)).replace("q", "e"),
        lambda: pick(string.ascii_lowercase, r.randint(12, 24)).capitalize(),
        lambda: pick(string.ascii_uppercase, r.randint(12, 20)),
        lambda: r.choice("-_/").join(words(1) for _ in range(r.randint(2, 5))).ljust(12, "e"),
        lambda: "".join(words(1).capitalize() for _ in range(r.randint(2, 4))).ljust(12, "e"),
        lambda: r.choice("-=_/+") * r.randint(12, 80),
        lambda: f"{words(1)} {pick(digits, r.randint(12, 24))}",
        lambda: f"{r.choice(('key', 'token', 'secret', 'Key'))}: {words(1).ljust(4, 'e')}",
        lambda: f"https://{words(1)}.example.com/{words(1)}/{words(1)}/{words(1)}",
        # hard ones: the words of private things without any, codes beside other words, long rows of numbers
        lambda: f"{r.choice(('password', 'passport', 'account', 'token', 'secret', 'pin'))} {r.choice(('is', 'was', 'no', 'code', ''))} {plain(1)}".replace("  ", " "),
        lambda: f"{r.choice(('account', 'passport', 'pin', 'token'))} {r.choice(('of', 'from', 'page', 'since'))} {r.randint(1000, 2030)}",
        lambda: f"{r.choice(('order', 'invoice', 'page', 'article', 'room'))} {pick(string.ascii_uppercase, 2)}{pick(digits, r.randint(4, 8))}",
        lambda: f"{words(1)}_{words(1)}_{pick(digits, r.randint(1, 6))}",
        lambda: " ".join(pick(digits, r.randint(2, 4)) for _ in range(r.randint(4, 60))),
        lambda: f"{words(1).capitalize()}{words(1).capitalize()}{pick(digits, 2)}.{words(1)}",
        lambda: f"{pick(digits, 3)}-{pick(digits, r.choice((1, 3)))}-{pick(digits, r.choice((2, 5)))}",
    )
    out = []
    for label, makers in ((1, good), (0, bad)):
        for i in range(n):
            made = makers[i % len(makers)]()
            text = f"{words(r.randint(0, 4))} {made} {words(r.randint(0, 4))}".strip()
            at = text.find(made)
            core = next(values(made), None)
            for kind, a, b in candidates(text):
                if b <= at or a >= at + len(made):
                    continue
                whole = (a, b) == (tuple(x + at for x in core) if core else (at, at + len(made)))
                if label and not whole and not (made[0] in "tpcPAa" and b == at + len(made)):
                    continue
                out.append((kind, features(text, kind, a, b), label))
    r.shuffle(out)
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, cuts: list) -> tuple | float:
    value = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return value
    best, base = None, g.sum() ** 2 / (h.sum() + 1.0)
    for j, edges in enumerate(cuts):
        for e in edges:
            left = x[:, j] <= e
            if 10 <= left.sum() <= len(x) - 10:
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, j, float(e), left)
    if best is None or best[0] < 1e-3:
        return value
    _, j, e, left = best
    return (j, e, _tree(x[left], g[left], h[left], depth - 1, cuts), _tree(x[~left], g[~left], h[~left], depth - 1, cuts))


def _leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(maxsize=1)
def trained(rounds: int = 24, rate: float = 0.3, precision: float = 0.995) -> dict:
    rows = examples()
    x, y, kinds = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float), [r[0] for r in rows]
    cut = len(rows) * 2 // 3
    cuts = [np.unique(np.quantile(x[:cut, j], np.linspace(0.05, 0.95, 12))) for j in range(x.shape[1])]
    score, trees = np.zeros(cut), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x[:cut], p - y[:cut], p * (1 - p), 3, cuts)
        trees.append(tree)
        score += rate * np.array([_leaf(tree, row) for row in x[:cut]])
    model = {"trees": trees, "rate": rate, "least": {}}
    for kind in ADDED:
        held = sorted(((probability(model, x[i]), y[i]) for i in range(cut, len(rows)) if kinds[i] == kind), reverse=True)
        # the lowest probability down to which the wanted precision holds at every point: only what is sure so far goes
        least, hits = 1.0, 0
        for n, (p, label) in enumerate(held, 1):
            hits += label
            if n < len(held) and held[n][0] == p:
                continue
            if n >= 20 and hits / n < precision:
                break
            least = p
        model["least"][kind] = least
    return model


def probability(model: dict, row) -> float:
    return 1 / (1 + math.exp(-model["rate"] * sum(_leaf(t, row) for t in model["trees"])))


def _free(spans: list, a: int, b: int) -> bool:
    """Whether [a, b) meets none of the sorted, disjoint spans."""
    i = bisect_left(spans, (b,))
    return i == 0 or spans[i - 1][1] <= a


def all_spans(text: str, model: dict) -> tuple[list, list]:
    """Base spans and the spans that the method adds."""
    base = base_spans(text)
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            a, b = taken[-1][0], max(b, taken.pop()[1])
        taken.append((a, b))
    scored = []
    for kind, a, b in candidates(text):
        if _free(taken, a, b) and (p := probability(model, features(text, kind, a, b))) >= model["least"][kind]:
            scored.append((a - b, -p, a, b, kind))
    added: list[tuple[int, int, str]] = []
    for _, _, a, b, kind in sorted(scored):
        if _free(added, a, b):
            insort(added, (a, b, kind))
    return base, sorted(((k, a, b) for a, b, k in added), key=lambda s: (ADDED.index(s[0]), s[1]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list) -> str:
    """Every stretch covered by spans becomes the name of its first span in brackets."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, counts of base kinds, base_sha256, spans."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    source = docs.select(*keep, docs[text].cast("string").alias("__text"))
    schema = source.drop("__text").schema
    for k in BASE:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches):
        for batch in batches:
            counts, digests, spans = {k: [] for k in BASE}, [], []
            for t in batch.column(len(keep)):
                base, added = all_spans(t.as_py() or "", model.value)
                for k in BASE:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return source.mapInArrow(lean(run), schema)


def redact_pii(docs: DataFrame) -> DataFrame:
    """The same rows with spans in ``text`` replaced; null texts stay null and n_chars follows the text."""
    model, at = docs.sparkSession.sparkContext.broadcast(trained()), docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redact(t, sum(all_spans(t, model.value), [])) for x in batch.column(at)]
            cols = batch.columns
            cols[at] = pa.array(texts, pa.string())
            if size is not None:
                cols[size] = pa.array([o if t is None else len(t) for t, o in zip(texts, batch.column(size).to_pylist())], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)
